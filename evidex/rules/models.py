"""Model catalog: limits and prices per million tokens."""

# Model, provider, context window, max output, input price, output price.
MODELS = (
    ("deepseek-r1:32b", "ollama", 32768, 16384, 0.0, 0.0),
    ("deepseek-r1", "ollama", 65536, 8192, 0.0, 0.0),
    ("deepseek-chat", "deepseek", 65536, 8192, 0.27, 1.10),
    ("deepseek-reasoner", "deepseek", 65536, 8192, 0.55, 2.19),
    ("gpt-4o", "openai", 128000, 16384, 2.50, 10.00),
    ("gpt-4o-mini", "openai", 128000, 16384, 0.15, 0.60),
    ("gpt-4.1", "openai", 1047576, 32768, 2.00, 8.00),
    ("gpt-4.1-mini", "openai", 1047576, 32768, 0.40, 1.60),
    ("gpt-4.1-nano", "openai", 1047576, 32768, 0.10, 0.40),
    ("claude-sonnet-4-5", "anthropic", 200000, 16384, 3.00, 15.00),
    ("claude-3-5-sonnet", "anthropic", 200000, 8192, 3.00, 15.00),
    ("claude-haiku-4-5", "anthropic", 200000, 8192, 1.00, 5.00),
    ("gemini-2.0-flash", "gemini", 1048576, 8192, 0.10, 0.40),
    ("gemini-3.6-flash", "gemini", 1048576, 8192, 0.10, 0.40),
    ("o4-mini", "openai", 200000, 100000, 1.10, 4.40),
    ("o3-mini", "openai", 200000, 100000, 1.10, 4.40),
    ("minimax/minimax-m2.7", "openrouter", 196608, 16384, 0.0, 0.0),
    ("nvidia/nemotron-3.5-lightning:free", "openrouter", 131072, 8192, 0.0, 0.0),
)

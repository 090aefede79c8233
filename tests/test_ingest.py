import pytest
from pyspark.sql import functions as F

from evidex.operators import ingest as op
from evidex.operators import stitch
from evidex.sources.documents import read_documents

def test_invalid_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff\xfe ok \xef\xbf\xbd end\xc3")
    (tmp_path / "b.md").write_text("plain")
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    got = {r["name"]: (r["mime"], r["text"]) for r in read_documents(spark, str(tmp_path)).collect()}
    expected = (tmp_path / "a.txt").read_bytes().decode("utf-8", errors="ignore")
    assert got["a.txt"] == ("text/plain", expected)
    assert got["b.md"] == ("text/markdown", "plain")
    assert got["c.bin"] == ("application/octet-stream", "")


@pytest.mark.parametrize("length", [0, 1, 999, 1000, 1001, 1200, 2200, 5003])
def test_windows_match_slicing(rows, length):
    text = "".join(chr(97 + i % 26) if i % 7 else " " for i in range(length))
    df = rows([("d", text)], "document_id string, text string")
    got = [(r["chunk_index"], r["text"], r["start_offset"]) for r in op.chunk_documents(df).orderBy("chunk_index").collect()]
    want = []
    for start in range(0, length, 1000):
        raw = text[start:start + 1200]
        if raw.strip():
            want.append((len(want), raw.strip(), start + len(raw) - len(raw.lstrip())))
    assert got == want


def test_overlap_wider_than_step(rows):
    text = "".join(chr(97 + i % 26) for i in range(50))
    df = rows([("d", text)], "document_id string, text string")
    got = [r["text"] for r in op.chunk_documents(df, size=20, overlap=15).orderBy("chunk_index").collect()]
    assert got == [text[s:s + 20] for s in range(0, 50, 5)]


def test_children_with_equal_index_are_both_kept(rows):
    schema = ("document_id string, chunk_id string, chunk_index bigint, chunk_text string, text string, content string, "
              "is_parent boolean, chunk_role string, ordinal bigint")
    first, second = "The opening part of the act speaks of duties.", "Another part entirely, about the powers of the board."
    points = rows([("d", "a", 0, first, None, None, False, "child", 0), ("d", "b", 0, second, None, None, None, "child", 1)], schema)
    row = stitch.best_document_text(points).first()
    assert row["chunk_count"] == 2 and first in row["text"] and second in row["text"]


def test_display_name_and_author(rows):
    df = rows([("CLOG ON DISCRETION\nBy Someone\ntext", "a/b.txt"), ("Section 5 of it\nx", "a/b.txt"), (" \n", "b.tar.gz"),
               ("A sentence that ends.\nmore", "n.txt")], "text string, filename string")
    got = df.select(op.derive_display_name("text", "filename").alias("n"), op.derive_author("text").alias("a")).collect()
    assert [tuple(r) for r in got] == [("CLOG ON DISCRETION", "By Someone"), ("b", None), ("b.tar", None), ("n", None)]


def test_reindex_is_idempotent(rows):
    schema = "document_id string, user_id string, chunk_index bigint, text string"
    index = rows([("d1", "u", 0, "old"), ("d2", "u", 0, "other"), ("d1", "v", 0, "kept")], schema)
    new = rows([("d1", "u", 0, "new"), ("d1", "u", 1, "more")], schema)
    once = op.upsert_document_chunks(index, new)
    twice = op.upsert_document_chunks(once, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert once.filter(F.col("text") == "old").count() == 0 and once.count() == 4

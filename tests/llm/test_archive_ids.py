"""Archives keep every payload of an id that comes with several; a worker's memory has a bound in bytes."""

from laborlens.llm import huffman, warc
from laborlens.llm.common import Scratch


def test_repeated_id_with_two_payloads(spark):
    pages = [(1, "u", "shared"), (2, "u", "shared"), (2, "u", "only here"), (2, "u", "shared"), (3, "u", "only here")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = Scratch(spark, "test").path("ids")
    warc.write_archives(df, path, record="html")
    found = warc.resolve_archives(warc.read_archives(spark, path)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found if r.record_type == "response") == [
        (1, 6, "response", None), (2, 9, "response", None)]
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in found if r.record_type == "revisit") == [
        (2, 6, 1), (2, 6, 1), (3, 9, 2)]
    assert {r.payload for r in found if r.payload is not None} == {"shared", "only here"}


def test_memory_is_bounded_in_bytes():
    memory = huffman.Memory()
    for i in range(1000):
        memory.learn(f"w{i}", b"\0" * 4 * (i % 7))
        memory.learn(f"w{i}", b"")
    assert memory.size == sum(huffman.ENTRY + 2 * len(c) + len(x) for c, x in memory.items())
    memory.forget(50_000)
    assert memory.size <= 50_000 and "w0" in memory and "w999" not in memory
    memory.forget(0)
    assert memory.size == 0 and not memory

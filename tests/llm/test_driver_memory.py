from pathlib import Path

from plumeline.llm import common


def resident(jvm):
    return int(Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/statm").read_text().split()[1]) * 4096


def test_cut_returns_what_the_drivers_allocator_keeps(spark):
    jvm = spark.sparkContext._jvm
    assert common.cut(spark.range(3)).count() == 3
    before = resident(jvm)
    # freed memory below a piece that is still in use stays with the allocator
    held = [jvm.java.util.zip.Deflater() for _ in range(800)]
    grown = resident(jvm)
    assert grown - before > 60_000_000
    for x in held[:-1]:
        x.end()
    assert common.cut(spark.range(3)).count() == 3
    assert resident(jvm) < before + (grown - before) / 2
    held[-1].end()


def test_cut_collects_garbage_of_a_large_heap_only(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", calls.append)
    monkeypatch.setattr(common, "HEAP_BYTES", 1 << 50)
    common.cut(spark.range(3))
    assert not calls
    monkeypatch.setattr(common, "HEAP_BYTES", 0)
    common.cut(spark.range(3))
    assert calls == [spark]

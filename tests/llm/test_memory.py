"""What own tables and workers leave behind: executors stay within their memory."""

import os

import public_tokenizers as P

from textloom.llm import byte_bpe, common, near_dup, toxicity


def test_own_tables_are_part_files_alone(spark):
    # Each checksum file costs processes that count as much memory as the executor that starts them.
    rows = spark.range(0, 100, 1, 4)
    out = common.written(rows, "plain")
    sketch = common.Sketch(rows.select("id"), "id")
    rarity = near_dup.Rarity(spark.createDataFrame([(bytearray(range(16)),)], "s binary"))
    assert sorted(r[0] for r in out.collect()) == list(range(100))
    folder = os.path.dirname(out.inputFiles()[0])
    for uri in (folder, sketch.path, rarity.path):
        path = uri.removeprefix("file://")
        assert all(n.startswith("part-") and n.endswith(".parquet") for n in os.listdir(path)) and os.listdir(path)


def test_workers_let_go_of_what_another_operator_kept(spark):
    common.holds("byte_bpe", byte_bpe.codec.cache_clear)
    byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    common.holds("byte_bpe", byte_bpe.codec.cache_clear)
    assert byte_bpe.codec.cache_info().currsize == 1
    common.holds("toxicity", toxicity.HASHES.forget)
    assert byte_bpe.codec.cache_info().currsize == 0
    before = toxicity.feature_ids("some words here").tolist()
    assert toxicity.HASHES.memo
    common.holds("sketch", common._loaded.cache_clear)
    assert not toxicity.HASHES.memo and toxicity.feature_ids("some words here").tolist() == before


def test_kernels_name_their_caches(spark, monkeypatch):
    # In the kernels themselves, as a worker runs them one after another.
    seen = []
    monkeypatch.setattr(common, "holds", lambda owner, let_go: seen.append(owner))
    common.Sketch(spark.range(10).select("id"), "id").may_hold(common.np.arange(3))
    assert seen == ["sketch"]

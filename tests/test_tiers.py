"""Tiers of merged parts, and symbols by process image."""

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from spoor.functions import frames
from spoor.streaming import jobs, tiers

FAN = 3


def part(spark, n):
    return spark.createDataFrame([(n % 4, "k", n + 1), (9, "k", 1)], jobs.RATES)


def total(spark, out):
    return tuples(jobs.added_rates(tiers.read_parts(spark, out, jobs.RATES, FAN)), "start_us", "n")


def wanted(n):
    sums = {}
    for i in range(n):
        sums[i % 4] = sums.get(i % 4, 0) + i + 1
    return sorted([*sums.items(), (9, n)], key=repr)


def test_parts_stay_few_and_every_batch_counts_once(spark, tmp_path):
    out = str(tmp_path)
    assert tiers.read_parts(spark, out, jobs.RATES, FAN).count() == 0
    for n in range(20):
        tiers.write_part(part(spark, n), out, n, jobs.added_rates, FAN)
        if n in (4, 8, 17):  # batches repeated after a restart: alone, and with their part merged away
            tiers.write_part(part(spark, n), out, n, jobs.added_rates, FAN)
    assert total(spark, out) == wanted(20)
    assert [(a, b) for _, a, b in tiers.parts(spark, out, FAN)] == [(0, 9), (9, 18), (18, 19), (19, 20)]
    assert len(list(tmp_path.glob("tier=*/part=*"))) == 4


def test_a_merge_that_dies_is_done_again(spark, tmp_path, monkeypatch):
    out = str(tmp_path)

    def dies(rows):
        raise KeyboardInterrupt

    for n in range(2):
        tiers.write_part(part(spark, n), out, n, jobs.added_rates, FAN)
    with pytest.raises(KeyboardInterrupt):
        tiers.write_part(part(spark, 2), out, 2, dies, FAN)
    assert total(spark, out) == wanted(3)  # its own part is there, the merged one is not
    with monkeypatch.context() as m:  # dies after the merge, half way through removing
        m.setattr(tiers, "_remove", dies_after(tiers._remove))
        with pytest.raises(TypeError):
            tiers.write_part(part(spark, 2), out, 2, jobs.added_rates, FAN)
    assert total(spark, out) == wanted(3)
    tiers.write_part(part(spark, 2), out, 2, jobs.added_rates, FAN)
    tiers.write_part(part(spark, 3), out, 3, jobs.added_rates, FAN)
    assert total(spark, out) == wanted(4)


def dies_after(remove):
    def wrapped(spark, name):
        remove(spark, name)
        raise TypeError

    return wrapped


def test_two_processes_with_one_address(spark):
    symbols = spark.createDataFrame([("p", 1, 0, "main"), ("p", 1, 1, "inlined"), ("p", 1, 1, "inlined"), ("q", 1, 0, "other"), ("r", 1, 1, "inlined"), ("r", 1, 0, "main")],
                                    "source_key string, addr bigint, inline_depth int, symbol_name string")
    samples = spark.createDataFrame([("p", "s", [1, 2]), ("p", "s", [1, 2]), ("q", "s", [1, 2]), ("r", "s", [2, 1]), ("none", "s", [1])], "source_key string, stack_id string, callchain array<bigint>")
    images, table = frames.shared_images(symbols, ["source_key"])
    by = {r.source_key: r.image for r in images.collect()}
    assert by["p"] == by["r"] != by["q"] and table.count() == 3
    got = frames.symbolize(samples, symbols, keys=["source_key"]).collect()
    assert {(r.source_key, tuple(r.frames)) for r in got} == {("p", ("inlined", "main", "0x2")), ("q", ("other", "0x2")), ("r", ("0x2", "inlined", "main")), ("none", ("0x1",))} and len(got) == 4
    plain = frames.symbolize(samples.filter("source_key = 'p'"), symbols.filter("source_key = 'p'")).collect()
    assert [r.frames for r in plain] == [["inlined", "main", "0x2"]]
    assert frames.symbolize(samples.limit(0), symbols, keys=["source_key"]).count() == 0 and frames.symbolize(samples, symbols.limit(0), keys=["source_key"]).filter(F.element_at("frames", 1) == "0x1").count() == 3

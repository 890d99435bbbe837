"""State over batches against whole tables; slices; sinks that write once; error rows; load-test files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from attnlens.operators import edges, signals, slices, snapshots, spectra
from attnlens.registry import Plan, compute
from attnlens.sources import loadtest
from attnlens.sources.tokens import KEY, tokens
from attnlens.streaming import prefixes, sinks, windows

SF = "/root/testdata/sf0.001"


def in_batches(tok, folder, cuts):
    """A file for each range of positions, read one a batch."""
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        tok.where((F.col("pos") >= a) & (F.col("pos") < b)).coalesce(1).write.mode("append").parquet(f"{folder}/in{k}")
    return [f"{folder}/in{k}" for k in range(len(cuts) - 1)]


def test_prefixes_on_the_state_store_equal_the_whole_table(spark, tmp_path):
    """Three batches, the last after a restart from the checkpoint."""
    tok = tokens(spark, SF).where("request_id < 2 and head = 0")
    parts = in_batches(tok, str(tmp_path), [0, 3, 11, 20])
    for name, streamed, whole in (("a", prefixes.asymmetry, signals.asymmetry_of_prefixes(edges.attention(tok))), ("c", prefixes.cyclic, signals.cyclic_prefixes(tok))):
        source = f"{tmp_path}/{name}"
        for few in (parts[:2], parts[2:]):
            for part in few:
                spark.read.parquet(part).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(tok.schema).option("maxFilesPerTrigger", 1).parquet(source)
            got = windows.drained(streamed(stream), f"{tmp_path}/{name}-out")
        rows = {(*(r[k] for k in KEY), r["n"]): r for r in got.collect()}
        want = whole.collect()
        assert len(rows) == len(want) == 80
        for r in want:
            mine = rows[(*(r[k] for k in KEY), r["n"])]
            assert all(abs(mine[c] - r[c]) < 1e-9 for c in r.asDict() if c not in KEY)


def test_a_request_that_begins_anew_drops_its_state(spark, tmp_path):
    tok = tokens(spark, SF).where("request_id = 0 and layer_idx = 0 and head = 0 and pos < 6").withColumn("turn", F.lit(0))
    both = tok.unionByName(tok.withColumn("turn", F.lit(1)))
    both.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(both.schema).parquet(f"{tmp_path}/in")
    got = sorted((r["n"], round(r["g"], 9)) for r in windows.drained(prefixes.asymmetry(stream, ["turn", "pos"]), f"{tmp_path}/out").collect())
    assert len(got) == 12 and got[::2] == got[1::2]


def held(spans, most):
    out, buffer = [], []
    for s in spans:
        buffer.append(s)
        while most > 0 and sum(buffer) > most:
            buffer.pop(0)
        out.append((len(buffer), sum(buffer)))
    return out


@pytest.mark.parametrize("most", [0, 7, 20])
def test_sliding_slices(spark, tmp_path, most):
    rng = np.random.default_rng(1)
    rows = [(u, i, int(rng.integers(1, 11))) for u in (1, 2) for i in range(40)] + [(3, 0, 50), (3, 1, 2)]
    df = spark.createDataFrame(rows, "u int, i int, span int")
    got = slices.sliding(df, "u", ["i"], "span", most).collect()
    for u in (1, 2, 3):
        mine = sorted((r for r in got if r["u"] == u), key=lambda r: r["i"])
        want = held([s for v, _, s in rows if v == u], most)
        assert [(r["n_slices"], r["n_tokens"]) for r in mine] == want
        assert [r["first"] for r in mine] == [i + 2 - n if n else None for i, (n, _) in enumerate(want)]
    if most == 7:
        for k in range(3):
            df.where(F.col("i") % 3 == k).withColumn("i", (F.col("i") / 3).cast("int")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        last = windows.drained(prefixes.slices(stream, "u", ["i"], "span", 7), f"{tmp_path}/out")
        assert last.count() == len(rows) and last.where("n_tokens > 7").count() == 0


def test_tumbling_slices_fire_whole(spark):
    rows = [("a", i, s) for i, s in enumerate((10, 5, 3, 16, 1, 1, 30))] + [(None, 0, 16)]
    got = slices.tumbling(spark.createDataFrame(rows, "u string, i int, span int"), "u", ["i"], "span", 16).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 0, 3, 18), ("a", 1, 1, 16), ("a", 2, 3, 32), (None, 0, 1, 16)], key=str)
    with pytest.raises(ValueError, match="size"):
        slices.tumbling(spark.createDataFrame(rows, "u string, i int, span int"), "u", ["i"], "span", 0)


def test_sliding_plans_take_the_last_tokens(spark):
    tok = tokens(spark, SF).where("request_id < 2 and layer_idx = 0")
    got = compute(tok, Plan("laplacian", window=5, interval=6)).collect()
    assert sorted({r["step"] for r in got}) == [6, 12, 18] and len(got) == 12 and all(len(r["eigvals"]) == 5 for r in got)
    alone = compute(tok.where("pos >= 7 and pos < 12").withColumn("pos", F.expr("pos - 7")), Plan("laplacian")).collect()
    want = {tuple(r[k] for k in KEY): r["eigvals"] for r in alone}
    assert all(np.allclose(r["eigvals"], want[tuple(r[k] for k in KEY)]) for r in got if r["step"] == 12)
    grown = compute(tok, Plan("cyclic", interval=10)).collect()
    assert sorted({r["step"] for r in grown}) == [10, 20]
    for wrong in ({"window": 6}, {"window": -1, "interval": 2}, {"method": "other"}):
        with pytest.raises(ValueError):
            Plan("asymmetry", **wrong)
    gap = compute(tok.where("pos != 2"), Plan("laplacian", window=5, tumbling=True)).collect()
    assert sorted({r["window_id"] for r in gap}) == [1, 2, 3]  # a window with a gap is not full


def snaps(spark):
    tok = tokens(spark, SF).where("request_id = 0 and layer_idx = 0")
    return snapshots.snapshots({"asymmetry": signals.asymmetry(edges.attention(tok)), "laplacian": signals.laplacian(edges.attention(tok))}, 20)


def test_a_batch_that_runs_again_writes_nothing_twice(spark, tmp_path):
    some = snaps(spark).cache()
    n = some.count()

    class Failing:
        path, calls = "none", 0

        def handle(self, batch, number):
            self.calls += 1
            if self.calls == 1:
                raise OSError("no room")

    bad = Failing()
    out = sinks.handlers([{"kind": k, "path": f"{tmp_path}/{k}"} for k in ("json", "spans", "lines")])
    write = sinks.to_all([bad, *out])
    with pytest.raises(RuntimeError, match="no room"):
        write(some, 0)
    write(some, 0)
    write(some, 1)
    assert [h.read(spark).count() for h in out] == [2 * n, 2 * (n + 1), 2 * n]
    assert out[0].read(spark).where("features.g is not null").count() == n
    assert out[2].read(spark).where("value like 'request=0 layer=0 head=%signal=asymmetry c=%'").count() == n
    for wrong in ([{"kind": "other", "path": "x"}], [{"kind": "json"}], [{"kind": "json", "path": "x"}, {"kind": "spans", "path": "x"}]):
        with pytest.raises(ValueError):
            sinks.handlers(wrong)


def test_one_bad_window_leaves_the_others(spark):
    p = edges.attention(tokens(spark, SF).where("request_id < 3 and layer_idx = 0 and head = 0"))
    bad = p.withColumn("p", F.when((F.col("request_id") == 1) & (F.col("i") == 4), float("nan")).otherwise(F.col("p")))
    got = {r["request_id"]: r for r in spectra.matrix_features(bad).collect()}
    want = {r["request_id"]: r for r in spectra.matrix_features(p).collect()}
    assert len(got) == 3 and got[1]["sigmas"] is None and got[1]["sigma2"] is None
    assert all(np.allclose(got[k]["sigmas"], want[k]["sigmas"]) for k in (0, 2))


def test_load_test_and_memory_files(spark, tmp_path):
    for name, doc in (("base-1.json", {"request_rate": 1.0, "output_throughput": 100.5, "request_throughput": 0.9, "extra": [1, {"a": 2}]}), ("base-2.json", {"request_rate": "inf", "output_throughput": 180, "completed": 3}),
                      ("with-1.json", {"output_throughput": None})):
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
    (tmp_path / "with-2.json").write_text("{broken")
    tests = loadtest.load_tests(spark, f"{tmp_path}/*.json")
    rows = {r["file"]: r for r in tests.collect()}
    assert rows["base-2.json"]["request_rate"] == float("inf") and rows["base-1.json"]["request_throughput"] == 0.9 and rows["with-2.json"]["broken"] is not None
    best = {r["run"]: tuple(r)[1:] for r in loadtest.best_rates(tests).collect()}
    assert best == {"base": (2, 0, float("inf"), None, 180.0), "with": (1, 1, None, None, None)}
    (tmp_path / "memory.csv").write_text("timestamp, memory.used [MiB]\n2024/01/01 00:00:01, 100 MiB\n2024/01/01 00:00:02, 2048 MiB\n2024/01/01 00:00:03, [N/A]\n2024/01/01 00:00:04, 7\n")
    peak = loadtest.peak_memory(loadtest.gpu_memory(spark, f"{tmp_path}/memory.csv")).first()
    assert (peak["n"], peak["peak_mib"]) == (3, 2048.0)

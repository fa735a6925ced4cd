"""Wells, their water samples and the laboratories that measured them: from Parquet and annotation to batches."""

import datetime as dt
import json
import os

import numpy as np
import pytest

from lattica.functions.embedders import Hashing
from lattica.operators import graph as G
from lattica.operators import profile as P
from lattica.operators.sampling import SamplerConfig
from lattica.plans.preprocess import preprocess
from lattica.plans.tasks import rewritten
from lattica.sources import tables as R
from lattica.sources.annotation import Annotation, SType, stype_of
from lattica.streaming.batches import Sampler, Shutdown

T0 = dt.datetime(2019, 6, 1, 8)
FIELD = {
    "name": "field",
    "tables": {
        "wells": {"primary_key": "well_id", "columns": {"well_id": {"stype": "identifier"}, "upstream": {"stype": "identifier", "foreign_key": "wells.well_id"}, "basin": {"stype": "categorical"}, "depth_m": {"stype": "numerical"}, "pumped": {"stype": "boolean"}, "log": {"stype": "text", "description": "Driller's log"}, "crew": {"stype": "ignored"}}},
        "labs": {"primary_key": "lab_id", "temporal_column": "licensed", "columns": {"lab_id": {"stype": "identifier"}, "basin": {"stype": "categorical"}, "staff": {"stype": "numerical"}, "licensed": {"stype": "timestamp"}}},
        "samples": {"temporal_column": "drawn", "columns": {"well": {"stype": "identifier", "foreign_key": "wells.well_id"}, "lab": {"stype": "identifier", "foreign_key": "labs.lab_id"}, "nitrate": {"stype": "numerical"}, "drawn": {"stype": "timestamp"}}},
    },
    "tasks": {
        "depth": {"query": "SELECT well_id, depth_m FROM 'wells.parquet' WHERE depth_m IS NOT NULL", "anchor_table": "wells", "anchor_key": "well_id", "target_column": "depth_m", "target_stype": "numerical"},
        "none": {"query": "SELECT well_id, depth_m FROM 'wells.parquet' WHERE depth_m < 0", "anchor_table": "wells", "anchor_key": "well_id", "target_column": "depth_m", "target_stype": "numerical"},
        "basin": {"query": "SELECT lab_id, basin FROM 'labs.parquet'", "anchor_table": "labs", "anchor_key": "lab_id", "target_column": "basin", "target_stype": "categorical"},
        "polluted": {"query": "SELECT l.lab_id, l.licensed + INTERVAL '5 days' AS seen, coalesce(max(s.nitrate) > 3, false) AS high FROM 'labs.parquet' l LEFT JOIN 'samples.parquet' s ON s.lab = l.lab_id AND s.drawn BETWEEN l.licensed AND l.licensed + INTERVAL '5 days' GROUP BY ALL", "anchor_table": "labs", "anchor_key": "lab_id", "observation_time_column": "seen", "target_column": "high", "target_stype": "boolean"},
    },
}
BASINS = ["upper", "lower"]
WELLS = [(f"{7 * i}", f"{7 * (i - 2)}" if i > 1 else None, BASINS[i % 2], 30.0 + i if i % 5 else None, i % 3 == 0, f"clay {i % 2}" if i % 4 else None, "x") for i in range(10)]
LABS = [(i, "coast" if i == 2 else "upper", T0 + dt.timedelta(days=i)) for i in range(4)]
#: Some samples name a well or a laboratory that is not there, or none.
SAMPLES = [(f"{7 * (i % 11)}", i % 5 if i % 6 else None, float(i % 7) if i % 4 else None, T0 + dt.timedelta(hours=9 * i)) for i in range(24)]


@pytest.fixture(scope="module")
def field(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("field"))
    spark.createDataFrame(WELLS, "well_id string, upstream string, basin string, depth_m double, pumped boolean, log string, crew string").coalesce(1).write.parquet(f"{at}/wells.parquet")
    spark.createDataFrame(LABS, "lab_id int, basin string, licensed timestamp_ntz").coalesce(1).write.parquet(f"{at}/labs.parquet")
    spark.createDataFrame(SAMPLES, "well string, lab int, nitrate double, drawn timestamp_ntz").coalesce(1).write.parquet(f"{at}/samples.parquet")
    return at, preprocess(spark, at, Annotation.parse(json.dumps(FIELD)), f"{at}/out", Hashing())


def test_annotation_round_trip(tmp_path):
    a = Annotation.parse(json.dumps(FIELD))
    assert json.loads(a.dump()) == FIELD
    assert stype_of("TEXT") == SType.TEXT and stype_of("jsonb") == SType.IGNORED
    assert a.resolve("labs.lab_id") == 7 and a.resolve("labs.x") is None and a.resolve(None) is None
    a.save(tmp_path / "a.json")
    with pytest.raises(FileExistsError):
        a.save(tmp_path / "a.json")
    a.save(tmp_path / "a.json", force=True)


def test_rewrite():
    assert rewritten("FROM 'a.parquet' x, 'ab.parquet'", ["a", "ab"]) == "FROM `a` x, `ab`"


def test_encoded_tables(field):
    _, db = field
    w = {r.row_id: r for r in db.table("wells").collect()}
    assert "crew" not in w[0].asDict() and w[0].depth_m is None and w[0].well_id is True and w[0].upstream is False and w[2].upstream is True
    assert w[0].pumped is True and w[1].pumped is False
    depths = [x[3] for x in WELLS if x[3] is not None]
    assert w[1].depth_m == pytest.approx((31 - np.mean(depths)) / np.std(depths, ddof=1), rel=1e-5)
    # one string, one number, also in two tables; a column that the data lack is null
    labs = {r.row_id: r for r in db.table("labs").collect()}
    assert labs[10].basin == w[0].basin and labs[12].basin not in (w[0].basin, w[1].basin) and labs[10].staff is None
    assert w[0].log is None and w[1].log == w[3].log and w[1].log != w[2].log
    assert db.metadata["columns"]["labs"]["staff"]["std"] == 1.0
    assert db.metadata["vocabulary"] == {"column": 15, "categorical": 3, "text": 2}
    assert db.value(10, "basin") == w[0].basin


def test_edges(field):
    _, db = field
    got = {(r.src, r.dst) for r in db.edges.collect()}
    want = {(i, i - 2) for i in range(2, 10)} | {(14 + i, i % 11) for i in range(24) if i % 11 < 10} | {(14 + i, 10 + i % 5) for i in range(24) if i % 6 and i % 5 < 4}
    assert got == want and db.metadata["edges"] == len(want)


def test_tasks(field):
    _, db = field
    assert [t["name"] for t in db.metadata["tasks"]] == ["depth", "basin", "polluted"]
    seeds = db.seeds.collect()
    high = {r.row_id: r for r in seeds if r.task == "polluted"}
    for i, (_, _, start) in enumerate(LABS):
        end = start + dt.timedelta(days=5)
        assert high[10 + i].obs == int((end - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
        assert high[10 + i].boolean == any(lab == i and n is not None and n > 3 and start <= t <= end for _, lab, n, t in SAMPLES)
    assert {r.row_id for r in seeds if r.task == "depth"} == {i for i in range(10) if i % 5}
    basins = {x.row_id: x.basin for x in db.table("labs").collect()}
    assert all(r.categorical == basins[r.row_id] for r in seeds if r.task == "basin")
    assert {r.split for r in seeds} <= {"train", "val", "test"}


def test_batches(field):
    _, db = field
    s = Sampler(db, SamplerConfig(batch_size=3, sequence_length=24, bfs_child_width=2, max_rows_per_seq=5, batches_per_job=2))
    x, again = s.batches("train", 0, 2)
    same = s.batches("train", 0, 1)[0]
    assert all(np.array_equal(x[k], same[k]) for k in x)
    alone = s.batches("train", 1, 1)[0]
    assert all(np.array_equal(again[k], alone[k]) for k in again)
    for b in (x, again):
        assert b["semantic_types"].shape == (3, 24) and b["timestamp_values"].shape == (3, 24, 15) and b["fk_adj"].shape == (3, 5, 5)
        assert (b["is_target"].sum(1) == 1).all() and (b["seq_row_ids"][:, 0] == 0).all()
        for i in range(3):
            used = b["is_padding"][i] == 0
            assert used.sum() <= 24 and b["seq_row_ids"][i][used].max() < 5
            for p in ("col_perm", "out_perm", "in_perm"):
                assert sorted(b[p][i].tolist()) == list(range(24))
                assert not b["is_padding"][i][b[p][i][: used.sum()]].any()
            texts = (b["semantic_types"][i] == 5) & used & (b["is_null"][i] == 0)
            assert (b["text_embed_ids"][i][texts] < len(b["text_batch_embeddings"])).all()
    assert s.column_embeddings().shape == (15, 256) and s.categorical_embeddings().shape == (3, 256)
    assert json.loads(s.database_metadata())["edges"] == db.metadata["edges"]
    assert s.next_train_batch()["task_idx"].shape == (1,)
    s.shutdown()
    with pytest.raises(Shutdown):
        s.next_train_batch()


def test_stream_goes_on_from_its_checkpoint(field, tmp_path):
    """A query that is stopped, and one whose last micro-batch was lost, give the batches that follow, bit for bit."""
    _, db = field
    s = Sampler(db, SamplerConfig(batch_size=2, sequence_length=24, bfs_child_width=2, max_rows_per_seq=5))
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for until in (3, 7):
        q = s.written_stream("train", path, checkpoint, each=2, until=until)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        got, want = s.read_stream(path, 0, 100), s.batches("train", 0, until)
        assert len(got) == until
        for a, b in zip(got, want, strict=True):
            assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) and a[k].dtype == b[k].dtype for k in a)
    assert [x["task_idx"][0] for x in s.read_stream(path, 5, 1)] == [want[5]["task_idx"][0]]
    # the last micro-batch is not known to be done, and its rows are half there: it is made once more in their place
    last = max(int(x.name) for x in (tmp_path / "checkpoint" / "commits").iterdir() if x.name.isdigit())
    for x in (tmp_path / "checkpoint" / "commits").iterdir():
        if str(last) in x.name.split("."):
            x.unlink()
    db.spark.read.parquet(path).filter("first = 5 and batch = 5").drop("first").write.mode("overwrite").parquet(path + "-half")
    os.replace(path + "/first=5", path + "-gone")
    os.replace(path + "-half", path + "/first=5")
    assert len(s.read_stream(path, 0, 100)) == 6
    q = s.written_stream("train", path, checkpoint, each=2, until=7)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = s.read_stream(path, 0, 100)
    assert len(got) == 7 and all(np.array_equal(a[k], b[k]) for a, b in zip(got, want, strict=True) for k in a)


def test_shards_cover_and_differ(field):
    _, db = field
    own = [Sampler(db, SamplerConfig(rank=r, world_size=2))._sizes for r in range(2)]
    n = {r.split: r["count"] for r in db.seeds.groupBy("split").count().collect()}
    for split, total in n.items():
        assert sum(sum(s[split].values()) for s in own) == total


def test_draft_and_tools(spark, field):
    at, _ = field
    assert R.listed(spark, at) == ["labs", "samples", "wells"]
    a = P.draft(spark, at, "field")
    assert a.tables["wells"].primary_key is None and a.tables["labs"].primary_key == "lab_id" and a.tables["samples"].columns["drawn"].stype == SType.TIMESTAMP
    assert a.tables["wells"].columns["pumped"].stype == SType.BOOLEAN
    assert [r["name"] for r in R.schema_rows(R.read(spark, at, "labs"))] == ["lab_id", "basin", "licensed"]
    R.read(spark, at, "labs").createOrReplaceTempView("b")
    assert R.query(spark, "SELECT lab_id FROM b ORDER BY 1")[0] == {"lab_id": "0"} and "error" in R.query(spark, "SELECT nope FROM b")[0]


def test_duplicate_keys_and_nulls(spark):
    rows = spark.createDataFrame([(1, 0), (1, 5), (None, 6), (2, 7)], "k long, row_id long")
    assert {(r.key, r.row_id) for r in G.key_rows(rows, "k").collect()} == {(1, 5), (2, 7)}
    fk = spark.createDataFrame([("1", 10), ("x", 11), (None, 12), ("9", 13)], "f string, row_id long")
    assert [(r.src, r.dst) for r in G.edges_of(fk, "f", G.key_rows(rows, "k"), 3).collect()] == [(10, 5)]


def test_several_files_are_numbered_by_name(spark, tmp_path):
    spark.range(100).repartition(5).write.parquet(f"{tmp_path}/t.parquet")
    got = R.with_local_rows(R.read(spark, str(tmp_path), "t")).collect()
    assert sorted(r[R.LOCAL] for r in got) == list(range(100))


def test_report_and_commands(spark, field, capsys, tmp_path):
    from lattica.__main__ import main
    from lattica.plans.inspect import grid

    at, db = field
    main(["inspect", "--db-dir", db.path, "--sample-rows", "2"])
    said = capsys.readouterr().out
    assert "polluted" in said and "out_degree" in said and "wells: 10 rows" in said
    main(["sample", "--db-dir", db.path, "--batch-size", "2", "--sequence-length", "16"])
    assert "references" in capsys.readouterr().out
    main(["draft", at, "--out", str(tmp_path / "d.json")])
    assert Annotation.load(tmp_path / "d.json").tables["labs"].primary_key == "lab_id"
    assert grid(["a"], [["bc"]]).splitlines()[0] == "┌────┐"

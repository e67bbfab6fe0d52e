"""Dataset versions against a replay of the log, digests of files, manifests."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from waymark.sources import sinks, versions

LOG = "at long, action string, dataset_id string, version_id string, validation_status string, note string"


def replayed(rows: list) -> tuple[dict, set]:
    """One entry after the other, as they came."""
    state, refused = {}, set()
    for at, action, dataset, version, told, _ in sorted(x for x in rows if None not in x[:4]):
        own = state.get((dataset, version))
        if action == "stage":
            state.pop((dataset, version), None)
            state[dataset, version] = [at, told == "passed", "validated" if told == "passed" else "candidate"]
        elif own is None or not own[1]:
            refused.add((dataset, version, at, action, "unknown" if own is None else "not passed"))
        else:
            for (other, _), peer in state.items():
                if other == dataset and (action == "rollback" or peer[2] == "active"):
                    peer[2] = "archived"
            own[2] = "active"
    return {k: (x[0], "passed" if x[1] else "failed", x[2]) for k, x in state.items()}, refused


@pytest.mark.parametrize("seed", range(4))
def test_a_log_comes_to_what_its_replay_does(spark, seed):
    r = random.Random(seed)
    rows = []
    for at in range(400):
        k = 0 if seed % 2 and r.random() < 0.6 else r.randrange(25)  # one version may hold most of the log
        rows.append((at, r.choice(["stage", "stage", "approve", "rollback"]), f"d{k % 4}", f"v{k}", "failed" if k % 5 == 4 else "passed", "x"))
    rows += [(None, "stage", "d0", "v0", "passed", ""), (900, None, "d0", "v0", "passed", ""), (901, "rollback", None, "v0", "passed", "")]
    log = spark.createDataFrame(rows, LOG)
    state, refused = replayed(rows)
    got = versions.lifecycle(log).collect()
    assert {(x.dataset_id, x.version_id): (x.staged_at, x.validation_status, x.status) for x in got} == state and len(got) == len(state)
    assert {tuple(x) for x in versions.refused(log).collect()} == refused and refused
    assert {tuple(x) for x in versions.lifecycle(log.unionAll(log)).collect()} == {tuple(x) for x in got}


def test_no_log(spark):
    none = spark.createDataFrame([], LOG)
    assert versions.lifecycle(none).collect() == [] == versions.refused(none).collect()
    only = spark.createDataFrame([(1, "approve", "d", "v", None, ""), (2, "stage", "d", "w", None, "")], LOG)
    assert [(x.version_id, x.validation_status, x.status) for x in versions.lifecycle(only).collect()] == [("w", "failed", "candidate")]
    assert [(x.version_id, x.reason) for x in versions.refused(only).collect()] == [("v", "unknown")]


def test_files(spark, tmp_path):
    for name, content in (("a.csv", b"x,y\n"), ("deep/b.bin", bytes(range(256)) * 5000), ("deep/c.csv", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.rglob("*.*") if p.stat().st_size}
    assert {x.path.rsplit("/", 1)[1]: (x.length, x.checksum) for x in versions.file_digests(spark, str(tmp_path)).collect()} == want
    files = spark.createDataFrame([("d", bytearray(b"x,y\n"), True), ("d", bytearray(b"x,y\n"), None), ("e", None, False)], "dataset_id string, content binary, fine boolean")
    one, two, null = versions.staged(files, F.col("fine")).collect()
    assert one.version_id == two.version_id == f"d-{want['a.csv'][1][:12]}" and (one.status, two.status) == ("validated", "candidate")
    assert null.checksum is None and null.status == "candidate"


def test_manifests(spark):
    rows = spark.createDataFrame([("x", "A", "1", {"k": 1.0}), ("y", "D", "2", None)], "artifact_id string, classification string, model_version string, parameters map<string,double>")
    made = sinks.manifest(rows, git_sha="abc").collect()
    assert [x.git_sha for x in made] == ["abc", "abc"] and made[0].input_data_versions == [] and made[1].scenario_id is None
    with pytest.raises(Exception, match="classification must be"):
        sinks.manifest(rows.withColumn("classification", F.lit("E"))).collect()
    old = spark.createDataFrame([("A1", ["b", "a", "b"], None)], "result_stage string, ui_capabilities array<string>, artifacts array<string>")
    new = sinks.merged_manifests(old, "A1", "A2", F.array(F.lit("c"), F.lit("a"), F.lit("c")), F.array(F.lit("f"))).first()
    assert new.ui_capabilities == ["b", "a", "b", "c"] and new.artifacts == ["f"] and new.ui_release_stage == "A2"
    for stage in ("A0", None):
        with pytest.raises(Exception, match="result stage changed"):
            sinks.merged_manifests(old.withColumn("result_stage", F.lit(stage).cast("string")), "A1", "A2", F.array(F.lit("c")), F.array(F.lit("f"))).collect()

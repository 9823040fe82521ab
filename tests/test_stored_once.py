"""Vectors are stored and shuffled as few times as the work allows; copies and their partitions do not change answers."""

import pyarrow as pa
import pytest

from bugsieve.operators import cells as ce
from bugsieve.operators import clustering as cl
from bugsieve.operators import encoders as en
from bugsieve.operators import similarity as sm
from bugsieve.operators import triage as tr
from bugsieve.session import cut_lineage
from tests.test_similarity import clustered, doc, frame


def with_copies(spark):
    rows = frame(spark, clustered(60, dim=4, seed=3), "defect_id", doc)
    again = rows.filter("defect_id < 'DEF-00020'").selectExpr("concat(defect_id, '-2') AS defect_id", "vector")
    return rows.unionByName(again)


@pytest.fixture
def packs(monkeypatch):
    made, real = [], ce.packed
    monkeypatch.setattr(ce, "packed", lambda *a, **k: made.append(1) or real(*a, **k))
    return made


def test_density_packs_the_points_once_a_phase(spark, packs):
    assert cl.density_labels(with_copies(spark), 0.1, 3).count() > 60
    assert len(packs) == 3


def test_rows_that_meet_themselves_are_packed_once(spark, packs):
    sm.near_duplicates(with_copies(spark), 0.9, exact=True).collect()
    assert len(packs) == 1


def test_blocks_are_cut_where_rows_lie(spark):
    rows = cut_lineage(frame(spark, clustered(90, dim=4, seed=3), "id", doc).repartition(2))
    for block_rows in (7, 60, 1000):
        blocks = [
            pa.ipc.open_stream(r["c"]).read_all() for r in ce.packed(rows, "c", 1 << 20, block_rows, in_place=True).collect()
        ]
        assert sorted(i for b in blocks for i in b["id"].to_pylist()) == [doc(i) for i in range(90)]
        assert max(b.num_rows for b in blocks) <= max(-(-4 * block_rows // 3), 1) + 1


@pytest.mark.parametrize("few", [0, 10**6])
def test_few_or_many_copies_give_one_answer(spark, monkeypatch, few):
    rows = with_copies(spark)
    want = {tuple(r) for r in cl.density_labels(rows, 0.1, 3).drop("vector").collect()}
    near = {tuple(r) for r in sm.near_duplicates(rows, 0.9, exact=True).collect()}
    monkeypatch.setattr(cl, "ALWAYS_COLD", few)
    monkeypatch.setattr(sm, "ALWAYS_COLD", few)
    assert {tuple(r) for r in cl.density_labels(rows, 0.1, 3).drop("vector").collect()} == want
    assert {tuple(r) for r in sm.near_duplicates(rows, 0.9, exact=True).collect()} == near
    assert any("-2" in r[0] for r in near) and len(want) == rows.count()


def test_decisions_do_not_compute_the_vectors_twice(spark):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    rows = frame(spark, clustered(40, dim=4, seed=3), "defect_id", doc)
    sparse = rows.selectExpr(
        "defect_id", "named_struct('indices', transform(vector, (x, i) -> cast(i AS bigint)), "
        "'values', transform(vector, x -> cast(x AS double))) AS vector"
    )
    assert tr.stored_decisions(sparse.mapInArrow(count, sparse.schema)).count() == 40
    assert ran.value == 40


def test_tokens_are_counted_where_their_row_lies(spark):
    rows = spark.createDataFrame([(1, ["b", "a"] * 700 + ["c"]), (2, []), (3, None), (4, ["x"])], "_row int, tokens array<string>")
    counts = en.term_counts(rows)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 700), (1, "b", 700), (1, "c", 1), (4, "x", 1)]


@pytest.mark.parametrize("hot", [0, 1, 3, 10**6])
def test_hot_terms_do_not_change_vectors(spark, monkeypatch, hot):
    rows = [(i, [f"w{j}" for j in range(6) if i % (j + 1) == 0] + ["every"]) for i in range(1, 13)]
    docs = spark.createDataFrame(rows, "defect_id int, tokens array<string>")
    encoder = en.TfIdfEncoder.fit(docs)
    monkeypatch.setattr(en, "HOT_TERMS", hot)
    weight = {r["token"]: (r["term"], r["idf"]) for r in encoder.terms.collect()}
    for r in encoder.encode(docs).collect():
        want = sorted((weight[t][0], weight[t][1]) for t in r["tokens"] if weight[t][1])
        assert r["vector"]["indices"] == [t for t, _ in want]
        length = sum(w * w for _, w in want) ** 0.5
        assert r["vector"]["values"] == pytest.approx([w / length for _, w in want])


def test_stored_vectors_take_little_room(spark):
    entries = [{"indices": list(range(i, i + 200)), "values": [0.07] * 200} for i in range(300)]
    rows = cut_lineage(spark.createDataFrame([(i, v) for i, v in enumerate(entries)], f"id int, vector {en.SPARSE_TYPE}"))
    size = sum(len(r["c"]) for r in ce.packed(rows, "c", 32 << 20).collect())
    assert size < 300 * 200 * 8  # the values alone


def test_packed_points_go_when_they_are_not_needed(spark, monkeypatch):
    made, real = [], ce.packed
    monkeypatch.setattr(ce, "packed", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    cl.density_labels(with_copies(spark), 0.1, 3).collect()
    kept = []
    for df in made:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        kept.append(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))
    assert kept == [False, True, False]  # the forest is read lazily


def test_noise_is_reassigned_where_rows_are_stored(spark, monkeypatch):
    rows = with_copies(spark)
    labelled = cl.density_labels(rows, 0.01, 3)
    want = sorted(map(tuple, cl.reassign_noise(labelled).select("defect_id", "cluster_id").collect()))
    stores, real = [], cl.cut_lineage
    monkeypatch.setattr(cl, "cut_lineage", lambda df: stores.append(df.columns) or real(df))
    assert sorted(map(tuple, cl.reassign_noise(labelled, stored=True).select("defect_id", "cluster_id").collect())) == want
    assert not any("vector" in c for c in stores)


def test_blocks_that_share_a_task_change_nothing(spark):
    rows = cut_lineage(frame(spark, clustered(90, dim=4, seed=3), "id", doc).repartition(2))
    every = ce.packed(rows, "c", 1 << 20, 2, in_place=True).repartition(60).localCheckpoint()
    found = [
        ce.map_packed(every, every, lambda q, c: {"n": [q.num_rows * c.num_rows]}, "n long", most) for most in (1, 4)
    ]
    assert [sum(r["n"] for r in f.collect()) for f in found] == [90 * 90] * 2
    assert found[1].rdd.getNumPartitions() < found[0].rdd.getNumPartitions()

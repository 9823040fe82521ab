"""The registered queries that SQL cannot state, and the pipeline, against plain restatements."""

import hashlib
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as contract  # noqa: E402
import corpus_pipeline  # noqa: E402
from bugsieve.llm import paragraphs, pii  # noqa: E402
from bugsieve.llm import queries as q  # noqa: E402
from tests.llm import brute  # noqa: E402
from tests.llm.test_tables import plain_parts  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="given tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    import tiktoken

    from bugsieve.llm.bpe import Ranks

    ranks = Ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    table = {b: r for r, b in ranks.bytes_of.items()}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def ids_bytes(tokenizer, text):
    return b"".join(i.to_bytes(4, "little") for i in tokenizer.encode_ordinary(text or ""))


def test_every_operator_has_its_query():
    names = contract.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and [len(x) for x in corpus_pipeline.STAGES] == [2] * 5


def test_op3(spark, docs):
    rows = q.op3(spark, str(DATA)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = brute.personal(docs[r["doc_id"]])
        spelled = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r["base_sha256"] == sha(",".join(spelled))
        assert [r[f"n_{k}"] for k in pii.PATTERN_KINDS] == [sum(s[0] == k for s in spans) for k in pii.PATTERN_KINDS]
        every = r["spans"].split(",") if r["spans"] else []
        assert set(spelled) <= set(every)
        keys = [(pii.KINDS.index(k), int(a)) for k, a, _ in (x.split(":") for x in every)]
        assert keys == sorted(keys)


def test_op6(spark, docs):
    rows = q.op6(spark, str(DATA)).collect()
    size = {i: len((t or "").encode()) + 1 for i, t in docs.items()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {
        (i, size[i], zlib.crc32((t or "").encode())) for i, t in docs.items()
    }
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    for k in range(8):
        mine = [r for r in rows if r["shard"] == k]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - sum(size.values()) / 8) <= max(size.values())


def test_op7(spark, docs, tokenizer):
    rows = q.op7(spark, str(DATA)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]
        ids = ids_bytes(tokenizer, text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, sha(ids), sha(text or ""))


def test_op8(spark, docs):
    rows = q.op8(spark, str(DATA)).collect()
    grams, holders = {}, {}
    for i, t in docs.items():
        for a, _, ws in paragraphs.paragraphs_of(t or ""):
            grams[i, a] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
            for g in grams[i, a]:
                holders.setdefault(g, []).append((i, a))
    near = {u: set() for u in grams}
    for units in holders.values():
        for u in units:
            near[u].update(units)
    alike = lambda u, v: len(grams[u] & grams[v]) >= 0.8 * len(grams[u] | grams[v])
    first = {}
    for u in sorted(grams):
        if u in first:
            continue
        todo, first[u] = [u], u
        while todo:
            x = todo.pop()
            for y in near[x]:
                if y not in first and alike(x, y):
                    first[y] = u
                    todo.append(y)
    sizes = {}
    for v in first.values():
        sizes[v] = sizes.get(v, 0) + 1
    want = {(*u, *v, sizes[v], u != v) for u, v in first.items() if sizes[v] > 1}
    assert {
        (r["doc_id"], r["start"], r["first_doc_id"], r["first_start"], r["n_alike"], r["removed"]) for r in rows
    } == want and len(want) > 20


def test_op9(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = q.op9(spark, str(DATA)).collect()
    assert {r["page_id"] for r in rows} == set(pages)
    for r in rows:
        assert (r["host"], r["path"]) == plain_parts(pages[r["page_id"]])
        verdict = dict((rule, v) for v, rule in q.URL_RULES).get(r["rule"])
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")


def test_op10(spark, docs):
    rows = q.op10(spark, str(DATA)).collect()
    prints = {i: brute.fingerprint(t) for i, t in docs.items()}
    label = brute.components(sorted(docs), lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 2)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {
        (i, f"{prints[i]:016x}", label[i]) for i in docs
    }


def test_pipeline(spark, docs, tokenizer):
    """Each stage on what its predecessor kept."""
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {i: t for i, t in docs.items() if brute.quality(t)[-1] == 0}
    prints = {i: brute.fingerprint(t) for i, t in kept.items()}
    label = brute.components(sorted(kept), lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 2)
    single = {i: t for i, t in kept.items() if label[i] == i}
    clean = {i: t for i, t in single.items() if not brute.contamination(t, items)[1]}
    assert len(docs) > len(kept) > len(single) > len(clean) > 50
    found = pii.find(list(clean.values()), pii.trained_field())
    masked = {i: pii.masked(t, base + added) for (i, t), (base, added) in zip(clean.items(), found)}
    assert masked != clean
    want = {}
    for i, t in masked.items():
        ids = ids_bytes(tokenizer, t)
        want[i] = (len(ids) // 4, ids, sha(ids), sha(t))
    rows = corpus_pipeline.run(spark, str(DATA)).collect()
    got = {r["doc_id"]: (r["n_tokens"], bytes(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in rows}
    assert got == want


def test_pipeline_stages_keep_the_columns(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "a@b.co " * 60, None, None, None)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (given, given.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, str(DATA))
            assert df.columns == given.columns
            df.collect()
        assert corpus_pipeline.token_ids(spark, df, str(DATA)).count() == 0
    masked = corpus_pipeline.personal_data(spark, given, str(DATA)).filter("doc_id IS NULL").head()
    assert masked["text"] == "<EMAIL> " * 60 and masked["n_chars"] == len(masked["text"])

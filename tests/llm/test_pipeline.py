"""Each stage of the pipeline on its own input, against a plain version."""

import hashlib
import random
import re

import corpus_pipeline as C
import pytest
from test_operators import BYTES, SCHEMA, odd_rows
from tokenizers import Tokenizer

from rasterlake.llm import quality, simhash


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def test_stages_in_order():
    assert [n for n, _ in C.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]


def test_exact_stage_keeps_one_row_of_each_text(spark, docs, sf_dir):
    out = C.drop_copies(spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = sorted(hashlib.md5((r.text or "").lower().encode() if (r.text or "").isascii() else (r.text or "").encode().lower()).hexdigest() for r in out.collect())
    want = sorted({hashlib.md5((t or "").encode().lower()).hexdigest() for _, t, *_ in odd_rows()})
    assert len(got) == len(want)
    assert {r.doc_id for r in out.collect() if (r.text or "").lower() == "same text twice"} == {101}


def test_near_stage_drops_only_rows_with_a_neighbour(spark, sf_dir):
    rows = odd_rows() + near_rows()
    kept = {r.text for r in C.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), sf_dir).collect()}
    for _, t, *_ in rows:
        assert t in kept or any(similar(shingle_set(t), shingle_set(other)) for _, other, *_ in rows if other != t)
    assert len(kept) < len({t for _, t, *_ in rows}) - 20


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def test_near_stage_with_split_groups(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 5)
    test_near_stage_equals_a_plain_version(spark, sf_dir)


def shingle_set(text):
    found = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "").replace("\x1c", "|").replace("\x85", "|")
    found = [w for w in re.split(r"[ \t-\r]+", found) if w]
    return frozenset(tuple(found[i : i + 5]) for i in range(max(min(1, len(found)), len(found) - 4)))


def near_rows():
    """Random texts, each with variants of one to many changed words, and a chain of small changes."""
    r = random.Random(4)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice((6, 30, 90, 200)))]
        rows.append(base)
        for changes in (0, 1, 1, 2, 3, 5, 9):
            own = list(base)
            for _ in range(changes):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append(own)
    chain = [r.choice(vocabulary) for _ in range(80)]
    for k in range(25):
        chain = [*chain[:k], "new", *chain[k + 1 :]]
        rows.append(chain)
    return [(1000 + i, " ".join(t), "en", "d", 1, 0.5, "f", "p", 3, 4) for i, t in enumerate(rows)]


def test_near_stage_equals_a_plain_version(spark, sf_dir):
    rows = odd_rows() + near_rows()
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    want = sorted(str(min((d for d in ids if d is not None), default=None)) for ids in low.values())
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(str(r.doc_id) for r in C.drop_near_copies(spark, docs, sf_dir).collect())
    assert got == want
    assert len(low) < len(set(sets)) - 20


def near_kept(rows):
    """(smallest doc_id of each component) of (doc_id, text) rows."""
    sets, low = [(d, shingle_set(t)) for d, t in rows], {}
    for d, a in sets:
        near = [k for k, own in low.items() if any(a == b or 5 * len(a & b) >= 4 * len(a | b) for _, b in own)]
        low[d] = [(d, a), *(x for k in near for x in low.pop(k))]
    return {min(d for d, _ in own) for own in low.values()}


def test_run_keeps_the_documents_of_a_plain_version(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    scores = quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), 0.3).collect()
    good = {r.doc_id for r in scores if r.score >= 0.3}
    assert {r.doc_id for r in C.keep_quality(spark, docs, sf_dir).collect()} == good and 0 < len(good)
    last = {}
    for d in sorted(good):
        last[texts[d].encode().lower()] = d
    kept = near_kept([(d, texts[d]) for d in last.values()])
    assert {r.doc_id for r in C.run(spark, sf_dir).collect()} == kept


def test_packing_stage_keeps_every_token(spark, docs, sf_dir):
    library = Tokenizer.from_file(BYTES)
    want = sorted((str(d), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, *_ in odd_rows())
    pieces = C.pack(spark, docs, sf_dir).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in pieces if r.start == 0) == want
    assert sum(r.length for r in pieces) == sum(n for _, n in want)


def test_secrets_stage_masks(spark, docs, sf_dir):
    out = C.mask_secrets(spark, docs, sf_dir)
    assert out.count() == len(odd_rows()) and out.columns == docs.columns
    assert out.filter("text like '%hunter2%' or text like '%deadbeef%'").count() == 0


def test_run_over_tables(spark, sf_dir):
    assert C.run(spark, sf_dir).count() > 0


def test_stages_take_no_rows(spark, docs, sf_dir):
    rows = docs.limit(0)
    for _, stage in C.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
        assert rows.columns == docs.columns
    assert C.pack(spark, rows, sf_dir).count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages_carry_columns_with_names_of_their_own(spark, sf_dir, stage):
    names = ["__id", "__hash", "__kid", "__khash", "__n", "__thin", "__first", "__quality", "__blob", "__spans", "held0"]
    rows = [(i, f"text number {i} with password = hunter2hunter2 and more words {i * 7}", "en", *[f"{n}{i}" for n in names]) for i in range(6)] + [(6, None, "en", *["x"] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    out = C.STAGES[stage][1](spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) >= 2
    for i, r in got.items():
        assert [r[n] for n in names] == ([f"{n}{i}" for n in names] if i < 6 else ["x"] * len(names))

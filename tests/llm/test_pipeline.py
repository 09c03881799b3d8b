"""The pipeline against a brute-force version of its stages."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from feedloom.llm import langid

public_tokenizers = pytest.importorskip("public_tokenizers")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def one_of_each_group(rows):
    def shingles(text):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text)]
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                low[max(x, y)] = min(x, y)
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def without_items(rows, items):
    passages = []
    for text in map(fold, items):
        size = min(120, len(text))
        passages += [text[s:s + size] for s in {*range(0, len(text) - size + 1, 40), len(text) - size}]
    return [r for r in rows if not any(p in fold(r["text"]) for p in passages)]


def mixed(rows):
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in rows}
    total = {}
    for r in rows:
        total[r["source"]] = total.get(r["source"], 0) + size[r["doc_id"]]
    names = sorted(total)
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, list(names), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if 2 * total[s] <= level * weight[s]]
        target |= {s: 2.0 * total[s] for s in over} if over else {s: level * weight[s] for s in open_}
        left -= sum(2 * total[s] for s in over)
        open_ = [s for s in open_ if s not in target]
    queue, done = [], dict.fromkeys(names, 0)
    tickets = sorted(((hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest(), r) for r in rows), key=lambda x: x[0])
    for ticket, r in tickets:
        s = r["source"]
        done[s] += size[r["doc_id"]]
        queue += [((done[s] + turn * total[s]) / target[s], names.index(s), turn, ticket, r) for turn in (0, 1)]
    out, served = [], 0
    for *_, r in sorted(queue, key=lambda x: x[:4]):
        served += size[r["doc_id"]]
        if served > 1.5 * sum(total.values()):
            break
        out.append(r)
    return out


def test_pipeline_equals_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    predicted = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs.where(~langid.held_out()))).collect()}
    rows = [r for r in docs.collect() if predicted[r["doc_id"]]["lang_pred"] != "und" and predicted[r["doc_id"]]["score"] >= 0.25]
    assert len(rows) > 0.95 * docs.count()
    unique = one_of_each_group(rows)
    clean = without_items(unique, [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    assert len(clean) < len(unique) < len(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(mixed(clean), key=lambda r: r["doc_id"]):
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids + [0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_stages_keep_the_columns_and_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = docs.where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf_dir)
        assert out.count() == 0
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns


@pytest.mark.parametrize("languages", [2, 4, 6])
def test_language_stage_rejects_unlearned_languages(spark, languages):
    """Texts in a language that was never learnt and gibberish go, short clean ones stay, however many languages there are."""
    r = random.Random(7)

    def tongue(sounds):
        syllables = [a + b for a in sounds for b in "aeiou"]
        return ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(120)]

    tongues = [tongue(x) for x in ("bdg", "ptk", "mnl", "szv", "fhj", "wrq")[:languages]]
    other = tongue(["th", "sh", "cr", "x"])
    rows = [(1000 * k + n, " ".join(r.choice(t) for _ in range(r.choice([4, 30, 200]))), f"l{k}") for k, t in enumerate(tongues) for n in range(80)]
    rows += [(10_000 + k, " ".join(r.choice(t) for _ in range(3)), None) for k, t in enumerate(tongues)]
    foreign = [(20_000 + n, " ".join(r.choice(other) for _ in range(r.choice([6, 30, 200]))), None) for n in range(30)]
    foreign += [(30_000 + n, "".join(r.choice("bcdfghjklmnpqrstvwxz ") for _ in range(300)), None) for n in range(10)]
    docs = spark.createDataFrame([(*x, "s", 0) for x in rows + foreign], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"] for x in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert not kept & {x[0] for x in foreign}
    assert len(kept) >= 0.99 * len(rows) and {x[0] for x in rows if 10_000 <= x[0]} <= kept


def test_given_columns_of_predicted_names_keep_their_values(spark):
    rows = [(i, "the cat and the house of the river " * 5 if i % 2 else "der Hund und das Haus am Fluss " * 5, ["de", "en"][i % 2], "s", 1, float(i), "mine") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string")
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    got = {(r.doc_id, r.score, r.lang_pred) for r in kept.collect()}
    assert got and got <= {(i, float(i), "mine") for i in range(40)}

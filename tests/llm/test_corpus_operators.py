"""The corpus operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from feedloom.llm import common, decontamination, extraction, jaccard, langid, mixing, substrings, suffixes, tokencount, tokenfile, vectors
from feedloom.llm.common import merged_runs, minimizers, window_hashes
from feedloom.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, crc string, part string, id string, bucket int, cls int, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, None, "x", "y", None, "z", 1, 2, "w") for i, t, lang, s in rows], SCHEMA)


def prose(r, n, tag=""):
    return " ".join(r.choice("the of and stone river über né cat dog house tree light moon".split()) + str(r.randint(0, 400)) + tag for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    shared = prose(r, 90)
    base = prose(r, 300)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace("the", "thy", 6), "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, " \t\n", None, ""),
            (7, prose(r, 120) + "\n" + shared, "fr", "b"), (8, shared + "  " + prose(r, 80), "fr", "c"), (9, "one", "de", "c"), (10, "One", "de", "c"), (11, "a b c d", None, "c"),
            (12, "A b  c\td", None, "c"), (13, prose(r, 30) + " x\x00y ▁   tail\r\nend  ", "en", "a"), (14, shared + " " + prose(r, 10) + " " + shared, "de", "a"),
            (15, "ab " * 300, "en", "a"), (16, "ab " * 400, "en", "b"), (17, "日本語" * 80, "en", None), (18, "123 456", "en", None), (19, prose(r, 30000), "en", "a"),
            (20, "line one two three four five six\n" * 60, "en", "b"), (None, base + " extra", "en", "b"), (-5, prose(r, 60), "en", "")]
    near = base.split()
    for k in range(21, 30):
        w = list(near)
        for _ in range(k - 20):
            w[r.randrange(len(w))] = "changed%d" % r.randint(0, 9999)
        rows.append((k, " ".join(w), "en", "hot"))
    return rows


def words(text):
    return WORD.findall(text or "")


def union_find(ids, links):
    low = {i: i for i in ids}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ---------------------------------------------------------------- helpers

def test_minimizers_depend_on_the_window_alone():
    r = np.random.default_rng(0)
    values = r.integers(1, 5, 4000).astype(np.uint64)
    values[3000:3300] = values[100:400]
    at, h = minimizers(values, 50, 8)
    assert (at[100:351] - 100 == at[3000:3251] - 3000).all() and (h[100:351] == h[3000:3251]).all()
    grams = window_hashes(values, 8)
    top = [int(np.argmin(grams[s:s + 43] >> np.uint64(24))) + s for s in range(len(values) - 49)]
    assert top == at.tolist()


def test_words_over_pieces_hash_alike(monkeypatch):
    texts = [b"ab cde  f\ngh", b"", b"x" * 90, b" ", "\u00e9 ab".encode(), b"cde"]
    whole = common.words_of(texts)
    for size in (1, 2, 3, 7, 16):
        monkeypatch.setattr(common, "CHUNK_BYTES", size)
        got = common.words_of(texts)
        assert got[0].tolist() == whole[0].tolist() and got[1].tolist() == whole[1].tolist()
    names = [w for t in texts for w in t.split()]
    assert whole[1].tolist() == [k for k, t in enumerate(texts) for _ in t.split()]
    assert len(set(whole[0].tolist())) == len(set(names)) and [names.index(w) for w in names] == [whole[0].tolist().index(h) for h in whole[0].tolist()]


def test_merged_runs():
    a, b = merged_runs(np.array([5, 0, 2, 9]), np.array([7, 3, 5, 10]))
    assert (a.tolist(), b.tolist()) == ([0, 9], [7, 10])


def test_components_of_long_chains_and_stars(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000), (7, 3), (3, 7), (-4, 199)]
    r.shuffle(links)
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == union_find(ids, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 mixing

def brute_mix(rows, weights=(5, 2, 1), passes=2):
    size = [len(words(t)) for _, t, _, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_ = Fraction(3, 2) * sum(size), list(names)
    target = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if passes * total[s] <= level * weight[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = Fraction(passes * total[s])
            left -= target[s]
            open_.remove(s)
    return size, total, target


def test_mix_targets_and_amounts(spark, corpus):
    got = mixing.mix(frame(spark, corpus)).collect()
    size, total, target = brute_mix(corpus)
    assert len(got) == len(corpus)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((i is None, i or 0, n) for (i, *_), n in zip(corpus, size))
    for r in got:
        assert r["source_size"] == total[r["source"]] and math.isclose(r["target"], float(target[r["source"]]), rel_tol=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert sum(r["taken"] for r in got) <= 1.5 * sum(size)
    assert sum(r["taken"] for r in got) > 1.5 * sum(size) - max(size)
    for s in total:
        most = max(n for n, r in zip(size, corpus) if r[3] == s)
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= most + 1
    again = mixing.mix(frame(spark, list(reversed(corpus))).repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_of_nothing_and_of_repeats(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    empty = mixing.mix(frame(spark, [(1, None, None, "a"), (2, " ", None, None)])).collect()
    assert [r["taken"] for r in empty] == [0, 0]
    twice = [(1, "a b c", None, "s")] * 3
    assert sum(r["taken"] for r in mixing.mix(frame(spark, twice)).collect()) in range(10, 14)
    rows = mixing.mixed_rows(frame(spark, [(k, "a b", None, "s") for k in range(10)]))
    assert rows.columns == frame(spark, []).columns and rows.count() == 15


def test_mixed_rows_of_one_id_or_none_are_taken_by_themselves(spark):
    """Rows without an id are mixed like others, as the budget of 1.5 passes shows, and spread over the queue."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"word {k}", None, "ab"[k % 2]) for k in range(300)]
    got = mixing.mixed_rows(frame(spark, rows)).collect()
    assert 895 <= sum(len(words(r["text"])) for r in got) <= 900
    assert {tuple(r)[:4] for r in got} <= set(rows)
    mixed = mixing.mix(frame(spark, rows)).collect()
    assert sum(r["taken"] for r in mixed) == sum(len(words(r["text"])) for r in got)
    none = [r["copies"] for r in mixed if r["doc_id"] is None]
    assert len(none) == 100 and len(set(none)) > 1 and 120 <= sum(none) <= 180


def test_one_row_is_kept_of_each_group(spark):
    r = random.Random(9)
    a, b, c, d = (prose(r, 40) for _ in range(4))
    rows = [(1, a, "en", "x"), (1, a, "en", "x"), (None, a, "en", "y"), (None, b, "en", "x"), (None, b, "en", "x"), (None, c, "en", "x"), (3, d, "en", "x"), (1, d, "en", "y"),
            (1, c + " end", "fr", "z"), (None, None, None, None), (None, "", "en", "x"), (5, "", None, None)]
    got = sorted(repr((r["doc_id"], r["text"])) for r in jaccard.first_of_each(frame(spark, rows)).collect())
    empty = [repr(x) for x in ((None, None), (None, ""), (5, ""))]
    assert [x for x in got if x not in empty] == sorted(map(repr, [(1, a), (None, b), (1, d), (1, c + " end")]))
    assert empty[2] in got and sum(x in got for x in empty[:2]) == 1
    assert jaccard.first_of_each(frame(spark, [])).count() == 0


def test_mix_has_no_python_and_no_nested_loop(spark, corpus):
    plan = mixing.mix(frame(spark, corpus))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|NestedLoop|Cartesian", plan)


# ---------------------------------------------------------------- 2 language

def test_language_by_kernels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(10**6, None, None, "x", 0), (10**6 + 1, "123 !? 4", "en", "x", 0), (10**6 + 2, "", None, "x", 0)], docs.schema))
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert {got[10**6 + k]["lang_pred"] for k in range(3)} == {"und"} and len(got) == docs.count()
    assert sum(got[i]["lang_pred"] == truth[i] for i in held if i < 10**6) / sum(i < 10**6 for i in held) > 0.93
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_model_is_kernel_ridge_regression():
    r = np.random.default_rng(0)
    bits = (r.random((30, 200)) < 0.3).astype(np.float32)
    bits[:15, :40] = 1
    names = ["a"] * 15 + ["b"] * 15
    model = langid.fit(bits, names, np.ones(30, bool), ridge=0.1)
    unit = bits / np.sqrt(bits.sum(1, keepdims=True))
    kernel = (unit @ unit.T).astype(np.float64)
    truth = np.where(np.array(names)[:, None] == np.array(["a", "b"]), 1.0, -1.0)
    assert np.allclose(model.scores(bits), kernel @ np.linalg.solve(kernel + 0.1 * np.eye(30), truth), atol=1e-3)


def test_language_without_labels_and_of_long_texts(spark):
    got = langid.identify(frame(spark, [(1, "some text", None, None), (None, "x", "en", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert langid.identify(frame(spark, [])).count() == 0
    whole, parts = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    text = "a river of stone " * 1000
    langid.presence(text, whole)
    old, langid.PIECE = langid.PIECE, 100
    try:
        langid.presence(text, parts)
    finally:
        langid.PIECE = old
    assert (whole == parts).all()


# ---------------------------------------------------------------- 3 decontamination

def edits(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_items_are_found_within_their_budget(spark):
    r = random.Random(5)
    items = [(k, prose(r, 12 + k)) for k in range(8)] + [(8, "short"), (9, None), (10, ""), (7, None)]
    rows, want = [], set()
    for k in range(60):
        text, item = prose(r, 40), items[k % 8]
        if k % 3 == 0:
            chars = list(item[1])
            for _ in range(k % 5):
                at = r.randrange(len(chars))
                chars[at:at + 1] = r.choice([[], ["q"], [chars[at], "z"]])
            text = prose(r, 30) + " " + ("".join(chars).upper() if k % 2 else "".join(chars)) + "\n" + prose(r, 30)
        rows.append((k, text, None, None))
        fold = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip()
        for i, s in items[:8]:
            size = min(len(fold(s)), 120)
            if edits(fold(s)[:size], fold(text)) <= min(int(0.1 * size), (size - 8) // 8):
                want.add((k, i))
    rows += [(100, None, None, None), (101, "", None, None), (None, items[3][1], None, None), (102, prose(r, 60000) + items[2][1] + " x", None, None), (102, "clean", None, None)]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = decontamination.leaks(frame(spark, rows), bench).collect()
    found = {(x["doc_id"], x["item_id"]) for x in got}
    assert want <= found and {(None, 3), (102, 2)} <= found and len({d for d, _ in found} - {d for d, _ in want} - {None, 102}) == 0
    span = next(x for x in got if x["doc_id"] == 102)
    assert items[2][1].lower() in rows[-2][1].lower()[span["start"]:span["stop"] + 1] and span["edits"] == 0
    clean = decontamination.clean(frame(spark, rows), bench)
    assert clean.columns == frame(spark, []).columns
    assert clean.count() == len(rows) - len([1 for i, t, *_ in rows if (i in {d for d, _ in found} and t != "clean")])


def test_no_items_and_no_documents(spark, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(frame(spark, corpus), none).count() == 0
    assert decontamination.clean(frame(spark, corpus), none).count() == len(corpus)
    assert decontamination.leaks(frame(spark, []), spark.createDataFrame([(1, "x" * 60)], "item_id long, text string")).count() == 0


def test_alignment_equals_full_edit_distance():
    r = random.Random(2)
    for _ in range(60):
        a = [r.randint(1, 3) for _ in range(24)]
        b = list(a)
        for _ in range(r.randint(0, 5)):
            b[r.randrange(len(b))] = 9
        text = [7] * 6 + b + [7] * 6
        best, _ = decontamination.align(np.array([a], np.uint32), np.array([text], np.uint32), 5)
        want = edits(a, text)
        assert best[0] == min(want, 6)


# ---------------------------------------------------------------- 4 extraction

@pytest.fixture(scope="module")
def chain():
    return extraction.train(extraction.labelled_pages(160), rounds=150)


def test_held_out_pages(chain):
    pages = extraction.labelled_pages(80, seed=11)
    right = sum(x == y for b, labels in pages for x, y in zip(chain.decode(b), labels))
    assert right / sum(len(b) for b, _ in pages) > 0.99


def test_article_without_its_surroundings(spark, chain):
    page = ("<html><head><title>t</title><script>var x='</p><article>';</script></head><body><div class='cookie-notice'><p>We use cookies here.</p></div><nav><ul><li><a href=/>Home</a>"
            "<li><a href=/x>News</a></ul></nav><article><h1>A &amp; B</h1><p><b>First  line<br>goes\n on.<p>Second &#233; one.</p><div class=\"ad\">Buy this now.</div><p>Be.</p></article>"
            "<section id=comments><p>Nice text, thanks for it.</p></section><footer>&copy; us</footer></body></html>")
    rows = [(1, "u", page, 5), (2, None, None, 5), (None, "v", "", 5), (4, "w", "<p", 5), (5, "x", "<<<>>> & <b", 5), (1, "u", page, 5)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"), chain).collect()
    want = "A & B\n\nFirst line goes on.\n\nSecond é one.\n\nBe."
    assert [r["text"] for r in got if r["page_id"] == 1] == [want] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == 6
    assert [r["text"] for r in got if r["page_id"] == 2] == [""]
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string"), chain).count() == 0


def test_elements_left_out_end_with_their_parent():
    def texts(page):
        return [b.text for b in extraction.leaf_blocks(page)]

    two = "<p>one</p><p>two</p></article>"
    assert texts('<article><svg class="i"/>' + two) == ["one", "two"]
    assert texts('<article><svg class="i"><path d="M0"/><text>no</text>' + two) == ["one", "two"]
    assert texts("<article><svg><path/>" + two + "<p>three</p><svg><text>no</text></svg>") == ["one", "two", "three"]
    for tag in ("select", "object", "noscript", "template"):
        assert texts(f"<article><div>a <{tag}><option>no<p>no</p><div>no</div></div>" + two) == ["a", "one", "two"]
        assert texts(f"<article><{tag}/>" + two) == ["one", "two"]
        assert texts(f"<article><{tag}><p>no<li>no</{tag}>" + two) == ["one", "two"]
    assert texts("<p>a<svg><svg/><foreignObject><div>no</div></foreignObject><text>no</text></svg>b</p>") == ["a b"]
    assert texts("<p>a<object>no<object>no</object>no</object>b</p>") == ["a b"]
    for tag in ("script", "style", "title", "textarea", "iframe"):
        assert texts(f"<p>a</p><{tag}>no<p>no</p>") == ["a"]
    assert texts("<p>a</p><!-- no <p>no</p>") == ["a"]


def test_viterbi_finds_the_best_labels(chain):
    blocks = extraction.labelled_pages(3, seed=5)[0][0][:9]
    score = chain.scores(blocks)

    def total(labels):
        return sum(s[x] for s, x in zip(score, labels)) + sum(chain.follow[a, b] for a, b in zip(labels, labels[1:]))
    every = [[k >> i & 1 for i in range(len(blocks))] for k in range(1 << len(blocks))]
    assert math.isclose(total([int(x) for x in chain.decode(blocks)]), max(map(total, every)))


# ---------------------------------------------------------------- 5, 8 tokens

def test_token_files_round_trip(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    extra = [(60, "a <|endoftext|> b", None, None), (61, "it's  we'll\n\nx\n y.\nZ!!", None, None), (2**40, "²x ß.", None, None), (1, "other text, same id", None, None)]
    rows = corpus + extra + corpus[:1]
    tokenizer = Tokenizer.from_file(path)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    want, start = [], 0
    for i, text, *_ in order:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokenfile.encoded_index(frame(spark, rows), path, str(tmp_path / "ids"))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    vocab = spark.read.parquet(str(tmp_path / "ids" / "vocab")).orderBy("rank").collect()
    assert [r["n"] for r in vocab] == sorted((r["n"] for r in vocab), reverse=True) and sum(r["n"] for r in vocab) == start
    assert tokenfile.encoded_index(frame(spark, []), path).count() == 0


def test_many_lines_without_spaces(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), tokenfile.Encoder(path)
    rows = ["\n".join(f"{k * 7919 % 10007},{k}" for k in range(20_000)), "a\nb\nc d\ne\n\nf's\n's\n", "x" * 5000 + "\ny", "w\n1\x1c\n2\x85\n3"]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(rows)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in rows]
    assert max(len(k[0] if isinstance(k, tuple) else k) for k in encoder) <= tokenfile.LONG_UNIT
    got = tokenfile.encoded_index(frame(spark, [(1, rows[0], None, None)]), path, str(tmp_path / "ids")).collect()
    assert got[0]["n_tokens"] == len(tokenizer.encode(rows[0], add_special_tokens=False).ids) + 1


def test_variable_length_codes():
    r = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (r.integers(0, 2**32, n, dtype=np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = tokenfile.pack_ranks(ranks)
        assert len(control) == -(-n // 4) and (tokenfile.unpack_ranks(control, data, n) == ranks).all()


def test_token_counts_equal_the_library(spark, corpus, sf_dir):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()][:60]
    rows = corpus + [(1000 + k, t, None, None) for k, t in enumerate([*texts, "  a", " a", "a  b\n\n c ", "\n", "\na\n", "a ", "x\n \ny", "<s> </s>", "▁ x", "a\0b", "a\tb\r\n"])]
    got = tokencount.token_counts(frame(spark, rows), path).collect()
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, *_ in rows]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert tokencount.token_counts(frame(spark, []), path).count() == 0


# ---------------------------------------------------------------- 6, 7 repeated text

def test_repeated_bytes_equal_brute_force(spark, corpus):
    rows = [r for r in corpus if r[0] != 19] + [(1, corpus[0][1], "x", "y")]
    seen, want = set(), []
    for i, text, *_ in sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b) + 1)
        for s in range(len(b) - 99):
            if b[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(b[s:s + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        want.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    want += [w for w in want if w[0] == 1]
    got = suffixes.dedup_bytes(frame(spark, rows).repartition(4)).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert sum(w[2] for w in want) > 3000
    assert suffixes.dedup_bytes(frame(spark, [])).count() == 0


def test_repeated_windows_equal_brute_force(spark, corpus):
    rows = corpus + [(1, corpus[0][1], "x", "y")]
    first = {}
    high = 1 << 63
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - 49):
            key = tuple(w[k:k + 50])
            first[key] = min(first.get(key, high), high if i is None else i)
    want = []
    for i, text, *_ in rows:
        w, gone = words(text), set()
        for k in range(len(w) - 49):
            if first[tuple(w[k:k + 50])] < (high if i is None else i):
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for bits in (None, 20):
        got = substrings.dedup_windows(frame(spark, rows).repartition(4), bits=bits).collect()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert sum(w[2] for w in want) > 500
    assert substrings.dedup_windows(frame(spark, [])).count() == 0


def test_a_full_sketch_loses_nothing(spark, corpus):
    """With every slot taken, all windows pass the prefilter and the result stays the same."""
    docs = frame(spark, corpus)
    tiny = substrings.dedup_windows(docs, bits=6).select("doc_id", "n_removed").collect()
    assert sorted(map(repr, tiny)) == sorted(map(repr, substrings.dedup_windows(docs).select("doc_id", "n_removed").collect()))


def test_windows_of_a_hot_group_fill_no_bucket(spark, monkeypatch):
    """Neither copies in one task nor an anchor with many surroundings send a bucket a record per occurrence."""
    r = random.Random(5)
    copied, common_words = prose(r, 300), prose(r, 30)
    rows = [(None if k % 3 == 0 else k, copied, None, None) for k in range(1, 400)]
    rows += [(k, prose(r, 60, f"x{k}") + " " + common_words + " " + prose(r, 60, f"y{k}"), None, None) for k in range(1000, 1400)]
    by_bucket = substrings.by_bucket

    def watched(batches, dtype):
        for bucket, records in by_bucket(batches, dtype):
            assert records.nbytes < 250_000, "a bucket holds too much"
            yield bucket, records

    monkeypatch.setattr(substrings, "by_bucket", watched)
    got = substrings.dedup_windows(frame(spark, rows).repartition(2)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got if r["n_words"] == 300} == {None: 300} | {k: 300 * (k > 1) for k in range(1, 400) if k % 3}
    assert not any(r["n_removed"] for r in got if (r["doc_id"] or 0) >= 1000)


def test_sketch_stays_packed_on_the_driver(spark, corpus):
    """The driver holds the two tables packed: an eighth of a byte a slot, not a byte."""
    import tracemalloc

    bits, rows = 26, common.keyed(frame(spark, corpus))
    tracemalloc.start()
    try:
        tables = substrings.sketch(rows, 50, 10, bits)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * (2 << bits - 3)
    slots: list[dict] = [{}, {}]
    for i, (_, text, *_) in enumerate(corpus):
        values, owner = common.words_of([(text or "").encode()])
        for _, _, _, h in common.window_runs(values, owner, 50, 10):
            for row in range(2):
                for slot in substrings._slots(h, row, bits).tolist():
                    slots[row].setdefault(slot, set()).add(i)
    for row in range(2):
        found = np.flatnonzero(np.unpackbits(tables[row], bitorder="little")).tolist()
        assert found and found == sorted(k for k, docs in slots[row].items() if len(docs) > 1)


# ---------------------------------------------------------------- 9, 10 near-duplicates

def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, union_find(sets, links), links


def test_jaccard_components_equal_brute_force(spark, corpus):
    high = (1 << 63) - 1
    rows = [(high if i is None else i, *x) for i, *x in corpus]
    sets, low, links = brute_components(rows)
    got = jaccard.near_duplicates(frame(spark, corpus + corpus[:1]).repartition(3)).collect()
    want = [(i, len(sets[high if i is None else i]), low[high if i is None else i]) for i, *_ in corpus + corpus[:1]]
    assert len(links) > 30
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0
    blank = jaccard.near_duplicates(frame(spark, [(2, None, None, None), (1, " ", None, None)])).collect()
    assert sorted(map(tuple, blank)) == [(1, 0, 1), (2, 0, 2)]


def test_jaccard_chains_at_the_threshold(spark):
    """Families of texts whose neighbours lie on either side of the threshold."""
    r = random.Random(9)
    rows = []
    for family in range(12):
        w = prose(r, r.choice([6, 12, 40, 150])).split()
        for k in range(14):
            w = list(w)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = "n%d" % r.randint(0, 10**6)
            rows.append((family * 100 + k, " ".join(w), None, None))
    sets, low, _ = brute_components(rows)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), low[i]) for i in sets}


def test_tree_bounds_lose_no_pair():
    r = np.random.default_rng(4)
    n = 300
    sets = [set(r.choice(3000, r.integers(20, 60), replace=False).tolist()) for _ in range(40)]
    while len(sets) < n:
        s = set(sets[r.integers(40)])
        for x in list(s)[:r.integers(0, 5)]:
            s.discard(x)
        sets.append(s)
    cell = np.empty(n, jaccard.POINT)
    for k, s in enumerate(sets):
        count = np.bincount([x % jaccard.GROUPS for x in s], minlength=jaccard.GROUPS)
        cell[k] = (0, k, 0, len(s), 0, count)
    cell = cell[np.argsort(cell["n"], kind="stable")]
    found = {(int(cell["cls"][a]), int(cell["cls"][b])) for i, j, _ in jaccard.tree_pairs(cell, 0.8) for a, b in zip(i, j)}
    found |= {(b, a) for a, b in found}
    assert all((a, b) in found for a in range(n) for b in range(n) if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert len(found) < n * n / 2


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(12, 24))
    rows = [(k, (base[k % 12] + r.normal(size=24) * r.choice([0.05, 0.2, 0.35])).astype(np.float32).tolist(), int(k % 3)) for k in range(300)]
    rows += [(300 + k, rows[5][1], 2) for k in range(20)] + [(400, None, 1), (401, [0.0] * 24, 1), (402, [1.0, None], 1), (403, [float("nan")] * 24, 1), (404, rows[5][1], None),
             (405, [], 1), (406, [1e30] * 24, 1), (407, [float("inf")] * 24, 1), (408, [1.0, 2.0], 1), (409, [1.0, 2.0], 1), (None, rows[5][1], 2)]
    schema = "vec_id long, embedding array<float>, label int, id string, members string, component string"
    ok = {i: (np.array(v, np.float64), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    links = []
    for a in ok:
        for b in ok:
            if a != b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]):
                x, y = ok[a][0], ok[b][0]
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                    links.append((a, b))
    high = (1 << 63) - 1
    key = lambda i: high if i is None else i
    low = union_find([key(i) for i, *_ in rows], [(key(a), key(b)) for a, b in links])
    degree = {i: sum(a == i for a, _ in links) for i, *_ in rows}
    want = [(i, degree[i], low[key(i)], key(i) == low[key(i)]) for i, *_ in rows]
    for tile in (1024, 16):
        got = vectors.near_duplicates(spark.createDataFrame([(*x, "a", "b", "c") for x in rows], schema), tile=tile).collect()
        assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in got)
    assert vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_suffix_bounds_lose_no_pair():
    r = np.random.default_rng(1)
    a = r.normal(size=(200, 40))
    b = np.vstack([a[:50] + r.normal(size=(50, 40)) * 0.2, r.normal(size=(100, 40))])
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    i, j = vectors.linked_pairs(a, b, 0.9)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.9))))


def test_python_gets_a_written_table_in_small_batches(spark):
    from pyspark.sql import functions as F

    from feedloom.llm.common import arrow, mapped, rows_out, written

    def sizes(batches):
        for batch in batches:
            yield rows_out(arrow("n long, size long"), [[batch.num_rows], [batch.nbytes]])

    ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    before = spark.conf.get(ARROW_BYTES)
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 8192).alias("text"))
    seen = written(mapped(rows, sizes, "n long, size long"), "sizes").collect()
    assert sum(r.n for r in seen) == 3000 and max(r.size for r in seen) <= BATCH_BYTES + (1 << 20)
    assert spark.conf.get(ARROW_BYTES) == before

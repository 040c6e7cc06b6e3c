"""Operators against brute force, on corpora with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fragweave.llm import chat, exact_dedup, fingerprint, jaccard_join, language_id, line_dedup, mixing, quality, toxicity
from fragweave.llm.components import components
from tests.llm.helpers import corpus, docs_of, sentence

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(4))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


# exact dedup

def test_exact_dedup_matches_grouping(docs, rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    kept = Counter()
    by_sha = {sha(t): (t, ids) for t, ids in groups.items()}
    for r in got:
        _, ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (min(known) if known else None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_exact_dedup_against_an_older_index(spark, tmp_path):
    first, second = [(5, "a  b"), (6, "c")], [(1, "a b"), (2, "d"), (3, "d")]
    path = str(tmp_path / "index")
    exact_dedup.DigestIndex(spark, path, 3).ingest(docs_of(spark, first)).collect()
    again = exact_dedup.DigestIndex(spark, path, 3)
    got = {r.doc_id: (r.keep_id, r.kept) for r in again.ingest(docs_of(spark, second)).collect()}
    assert got == {1: (5, False), 2: (2, True), 3: (2, False)}
    assert sorted(r.keep_id for r in again.rows().collect()) == [2, 5, 6]


def test_exact_dedup_of_a_batch_ingested_again(spark, tmp_path):
    rows, path = [(1, "a b"), (2, "a  b"), (3, "c"), (None, "d")], str(tmp_path / "index")
    first = exact_dedup.DigestIndex(spark, path, 3).ingest(docs_of(spark, rows), batch="monday")
    again = exact_dedup.DigestIndex(spark, path)  # the stored number of buckets holds
    second = again.ingest(docs_of(spark, rows).repartition(3), batch="monday")
    assert again.buckets == 3 and again.rows().count() == 3
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect())) and sum(r.kept for r in second.collect()) == 3
    assert not any(r.kept for r in again.ingest(docs_of(spark, rows), batch="tuesday").collect())
    with pytest.raises(ValueError, match="3 buckets"):
        exact_dedup.DigestIndex(spark, path, 5)


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


# Jaccard join

def brute_components(rows, k, percent):
    sets = defaultdict(list)
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
            sets[doc_id].append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    label = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b
             and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return sets, label


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard_components_match_brute_force(docs, rows, k, percent):
    sets, label = brute_components(rows, k, percent)
    got = jaccard_join.jaccard_components(docs, k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.component_id == label[r.doc_id], r
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def test_jaccard_components_of_many_small_sets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.sample("a b c d e f g h i j k l m n o p".split(), rng.randint(4, 16)))) for i in range(250)]
    for percent in (70, 85):
        _, label = brute_components(rows, 1, percent)
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs_of(spark, rows), 1, percent).collect()}
        assert got == label


def test_jaccard_components_chain_of_near_copies(spark):
    # every text is similar to its neighbours only; a pivot alone would lose most links
    words = sentence(random.Random(1), 400).split()
    rows = [(i, " ".join(words[10 * i:10 * i + 150])) for i in range(26)]
    _, label = brute_components(rows, 4, 85)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs_of(spark, rows)).collect()}
    assert got == label and set(label.values()) == {0}


def test_jaccard_components_of_nothing(empty):
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_boundary_weighs_subsets_against_lists():
    assert jaccard_join.boundary({8: 1000}, 1000.0, 85) >= 8
    assert jaccard_join.boundary({30: 1000}, 0.0, 85) < 30
    assert all(jaccard_join.overlap_needed(a, b, 85) == min(i for i in range(a + b + 1) if 100 * i >= 85 * (a + b - i)) for a in range(1, 30) for b in range(1, 30))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102)], "a bigint, b bigint")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


# lines

def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, d in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != d)))
        p = q
    return p[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i, how = rng.randrange(len(s)), rng.randrange(3)
        if how == 0:
            s[i] = rng.choice("abé")
        elif how == 1 and len(s) > 3:
            del s[i]
        else:
            s.insert(i, rng.choice("abé"))
    return "".join(s)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_distance(spark, k):
    rng = random.Random(k)
    pairs = []
    for _ in range(500):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(4, 14)))
        pairs.append((a, edited(rng, a, rng.randint(0, 5))))
    got = spark.createDataFrame(pairs, "a string, b string").where(F.length("b") >= k).select("a", "b", line_dedup.within(F.col("a"), F.col("b"), k).alias("w")).collect()
    assert all(r.w == (levenshtein(r.a, r.b) <= k) for r in got)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(18, 40))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [edited(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join([*lines, "short", ""])))
    rows += [(70, None), (71, ""), (72, "\n\n"), (None, pool[0] + "\nx")]
    seen, want = [], {}
    for doc_id, text in rows:
        left = []
        for line in (text or "").split("\n"):
            near = line in seen and line.strip() or len(line) >= 20 and any(len(m) >= 20 and abs(len(line) - len(m)) <= 2 and levenshtein(line, m) <= 2 for m in seen)
            seen.append(line)
            if not near:
                left.append(line)
        want[doc_id] = None if text is None else "\n".join(left)
    got = line_dedup.dedup_lines(docs_of(spark, rows).repartition(3))
    assert "extra" in got.columns
    assert {r.doc_id: r.text for r in got.collect()} == want
    count = {r.doc_id: (r.n_lines, r.n_dropped) for r in got.collect()}
    for doc_id, text in rows:
        n = len(text.split("\n")) if text is not None else 0
        assert count[doc_id][0] == n and count[doc_id][1] == (n - len(want[doc_id].split("\n")) if text is not None else 0)
    assert "short" not in want[59]  # equal lines of any length go; a line of white space never does


def test_line_dedup_of_texts_that_share_an_id_or_have_none(spark):
    tails = ["the quick brown fox jumps", "pack my box with five dozen jugs", "sphinx of black quartz judge my vow", "how vexingly daft zebras run about"]
    same, near = "a line that both of them begin with", "another line that both of them hold"
    rows = [(None, f"{same}\n{tails[0]}"), (None, f"{same}\n{tails[1]}"), (5, f"{near}\n{tails[2]}"), (5, f"{near[:-1]}D\n{tails[3]}"), (6, None), (6, "x")]
    got = line_dedup.dedup_lines(docs_of(spark, rows).repartition(3)).collect()
    left = [line for r in got if r.text is not None for line in r.text.split("\n")]
    assert len(got) == 6 and sorted(line for line in left if line in tails) == sorted(tails)
    assert left.count(same) == 1 and left.count(near) + left.count(near[:-1] + "D") == 1
    assert sum(r.n_dropped for r in got) == 2


def test_line_dedup_of_nothing(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


# fingerprints

def test_fingerprints_match_edits_and_jaccard(docs, rows):
    order = sorted({(d if d is not None else -(1 << 63), t or "") for d, t, *_ in rows}, key=lambda r: -r[0])
    got = fingerprint.compared_with_edits(docs).collect()
    assert len(got) == len(rows)
    prints, seen = {}, Counter()
    for r in got:
        same = [t for d, t in order if d == (r.doc_id if r.doc_id is not None else -(1 << 63)) and len(t) == r.n_chars]
        assert same
        seen[r.doc_id] += 1
        if len(same) == 1 and sum(d == r.doc_id for d, _ in order) == 1:
            text = same[0]
            at = next(i for i, (d, _) in enumerate(order) if d == r.doc_id)
            near = {t for d, t in order if d == order[(at + 1) % len(order)][0]}
            cut = len(text) // 3
            assert r.edited_sha256 in {sha(text[:len(text) - cut] + n[:cut]) for n in near}
            assert prints.setdefault(text, r.fingerprint) == r.fingerprint
            assert (r.fingerprint == "") == (not WORD.search(text))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert seen == Counter(d for d, *_ in rows)


def test_fingerprint_likeness_is_the_generalised_jaccard_similarity(spark):
    rng = random.Random(2)
    pairs = []
    for i in range(60):
        a = [rng.choice("a b c d e f g h".split()) for _ in range(40)]
        b = a[:30] + [rng.choice("x y z".split()) for _ in range(12)]
        pairs.append((i, " ".join(a), " ".join(b)))
    marks = fingerprint.sampled(spark.createDataFrame(pairs, "id int, a string, b string"), ["id"], {"ma": "a", "mb": "b"}, 64)
    got = {r.id: r.s for r in marks.select("id", fingerprint.likeness(F.col("ma"), F.col("mb")).alias("s")).collect()}
    miss = 0.0
    for i, a, b in pairs:
        x, y = Counter(a.split()), Counter(b.split())
        miss += got[i] - sum((x & y).values()) / sum((x | y).values())
    assert abs(miss / len(pairs)) < 0.02


def test_fingerprints_of_nothing_and_of_one(spark, empty):
    assert fingerprint.compared_with_edits(empty).count() == 0
    r = fingerprint.compared_with_edits(docs_of(spark, [(1, "a b c d e f")])).first()
    assert r.edited_sha256 == sha("a b c d e f"[:8] + "a b") and r.near_next == 1.0


# mixing

def test_mix_reaches_targets(docs, rows):
    sizes, total = Counter(), Counter()
    for _, t, _, s in ((*r, *(None,) * (4 - len(r))) for r in rows):
        total[s] += len(WORD.findall(t or ""))
    order = sorted([s for s in total if s is not None], key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * total[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else share * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9)
        assert r.copies in (0, 1, 2)
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
        sizes[r.source] += 1
    for s in order:
        assert abs(taken[s] - target[s]) <= max(1, largest[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_mix_solves_the_tilt(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, rng.randint(1, 200)), "en", f"s{i % 3}") for i in range(300)]
    got = mixing.mix(docs_of(spark, rows)).groupBy("source").agg(F.sum(F.col("rate") * F.col("size")).alias("words"), F.first("target").alias("target")).collect()
    assert all(r.words == pytest.approx(r.target, rel=1e-5) for r in got)


def test_mix_of_nothing(spark, empty):
    assert mixing.mix(empty).count() == 0
    assert [r.copies for r in mixing.mix(docs_of(spark, [(1, None), (2, "")])).collect()] == [1, 1]


# chat

def test_chat_round_trip(spark):
    odd = ["a<|end|>b", "<|turn|>user\nx", "\\0", "\\1|", "<\\1|", "\\\\2", "<", "<|", "", None, "é\n\n😀"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)] + [(2, 0, "od\nd<|r\\2", "x"), (2, 1, None, None), (None, 3, "user", "y"), (2, None, "assistant", "z"), (2, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("extra", F.lit(1))
    formatted = chat.formatted(chat.canonical(df))
    got = {r.conv_id: r for r in chat.parsed(formatted).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(odd)]
    assert got[1].loss_text == "".join((t or "") for i, t in enumerate(odd) if i % 2)
    assert [(t.role, t.text) for t in got[2].turns] == [("assistant", "z"), ("assistant", "z"), ("od\nd<|r\\2", "x"), ("", "")]
    assert got[2].loss_text == "zz" and got[None].turns[0].text == "y"
    assert all(r.formatted.count(chat.OPEN) == r.formatted.count(chat.CLOSE) == len(got[r.conv_id].turns) for r in formatted.collect())


def test_chat_layouts_agree(spark):
    want = [("user", "q"), ("assistant", "a")]
    layouts = [
        ("prompt string, response string", ("q", "a")), ("prompt string, completion string", ("q", "a")), ("instruction string, input string, output string", ("q", "", "a")),
        ("messages array<struct<role: string, content: string>>", ([("user", "q"), ("assistant", "a")],)),
        ("conversations array<struct<from: string, value: string>>", ([("human", "q"), ("gpt", "a")],)), ("question string, answer string", ("q", "a")),
    ]
    for schema, row in layouts:
        df = spark.createDataFrame([(1, *row)], f"conv_id int, {schema}")
        assert [(t.role, t.text) for t in chat.canonical(df).first().turns] == want
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical(spark.createDataFrame([(1, "x")], "conv_id int, other string"))


def test_chat_json_records_of_mixed_layouts(spark):
    rows = [(1, '{"response":"b","prompt":"a"}'), (2, '{"messages":[{"role":"human","content":"x"},{"role":"gpt","content":"y"}]}'), (3, '{"z":1}'), (4, None), (5, "{bad"),
            (6, '{"instruction":"do","input":"it","output":"done"}')]
    got = {r.conv_id: r.turns and [(t.role, t.text) for t in r.turns] for r in chat.canonical_json(spark.createDataFrame(rows, "conv_id int, j string"), "j").collect()}
    assert got == {1: [("user", "a"), ("assistant", "b")], 2: [("user", "x"), ("assistant", "y")], 3: None, 4: None, 5: None, 6: [("user", "do\n\nit"), ("assistant", "done")]}


def test_chat_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.parsed(chat.formatted(chat.canonical(df))).count() == 0


# classifiers

def test_language_id(spark):
    rng = random.Random(5)
    words = {"xx": "kat hond boom huis water", "yy": "perro gato agua casa árbol", "zz": "собака кот дом вода лес"}
    rows = [(i, sentence(rng, 30, words[lang]), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 120)]
    rows += [(900, "kat hond", None), (901, None, "xx"), (902, "123 !!", "xx"), (903, "", "yy"), (None, "gato agua casa", "yy"), (904, sentence(rng, 60_000, words["zz"]), None)]
    docs = docs_of(spark, rows + rows[:3])
    got = language_id.predict(docs, language_id.fit(language_id.training_docs(docs))).collect()
    assert len(got) == len(rows) + 3
    truth = {d: lang for d, _, lang in rows[:360]} | {900: "xx", 904: "zz", None: "yy", 901: "und", 902: "und", 903: "und"}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.99 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    assert {r.doc_id for r in language_id.training_docs(docs).collect()} == {d for d, t, lang in rows if d is not None and t is not None and lang is not None and not held(d)}


def test_language_id_without_languages(spark, empty):
    model = language_id.fit(language_id.training_docs(empty))
    assert language_id.predict(empty, model).count() == 0
    assert language_id.predict(docs_of(spark, [(1, "words")]), model).first().lang_pred == "und"


def test_language_id_learns_every_language(spark):
    rng = random.Random(9)

    def text(n):
        return "".join(rng.choice([chr(0x4E00 + 12 * n + j) for j in range(12)]) for _ in range(60))

    rows = [(10 * n + i, text(n), f"l{n:03d}") for n in range(120) for i in range(10 if n < 60 else 6)]
    once = [(d, text(200 + d % 1000), f"once{d}") for d in range(5000, 5024) if zlib.crc32(str(d).encode()) % 4 != 2]
    docs = docs_of(spark, rows + once)
    model = language_id.fit(language_id.training_docs(docs))
    assert set(model.languages) == {r[2] for r in rows + once}
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert [(d, got[d]) for d, _, lang in rows + once if got[d] != lang] == []
    with pytest.raises(ValueError, match="more than 3 languages"):
        language_id.fit(language_id.training_docs(docs), table_bytes=3 * 8 * language_id.BINS)


def labelled(spark, rows, bad):
    return spark.createDataFrame([(d, int(bad(t)), int(bad(t))) for d, t, *_ in rows if d is not None and t], "doc_id bigint, toxic int, quality int")


def test_toxicity(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        text = sentence(rng, rng.randint(5, 60)).split()
        if i % 4 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(["scoundrel", "dimwit", "dimwits"]))
        rows.append((i, " ".join(text)))
    docs, labels = docs_of(spark, rows), labelled(spark, rows, lambda t: "scoundrel" in t or "dimwit" in t)
    lexicon = toxicity.fit(toxicity.training_rows(docs, labels, "toxic"), exceptions=("scoundrel days",))
    assert 1 <= len(lexicon.weights) <= 6
    cases = {1: ("Alpha SCOUNDREL beta", 1), 2: ("alpha sc0undr3l beta", 1), 3: ("alpha dіmwіt beta", 1), 4: ("alpha scoundrel days beta", 0), 5: ("alpha beta", 0), 6: (None, 0), 7: ("", 0),
             8: (sentence(rng, 20_000) + " dimwitted", 1), 9: ("ａｌｐｈａ ｄｉｍｗｉｔ", 1)}
    got = toxicity.score_documents(docs_of(spark, [(k, t) for k, (t, _) in cases.items()]), lexicon).collect()
    assert {r.doc_id: r.predicted for r in got} == {k: v for k, (_, v) in cases.items()}


def test_toxicity_and_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    lexicon = toxicity.fit(toxicity.training_rows(docs, none, "toxic"))
    assert {r.predicted for r in toxicity.score_documents(docs, lexicon).collect()} == {0}
    assert toxicity.score_documents(empty, lexicon).count() == 0
    vectors = quality.word_vectors(docs)
    net = quality.fit(toxicity.training_rows(docs, none, "quality"), vectors)
    assert {r.score for r in quality.score_documents(docs, vectors, net).collect()} == {0.5}
    assert quality.score_documents(empty, quality.word_vectors(empty), net).count() == 0


def test_quality(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        text = sentence(rng, rng.randint(20, 60))
        rows.append((i, re.sub(r"(\w+)", r"\1$$$", text) if i % 4 == 0 else text))
    rows += [(500, None), (501, ""), (None, sentence(rng, 20))]
    docs, labels = docs_of(spark, rows + rows[:2]), labelled(spark, rows, lambda t: "$$$" not in t)
    vectors = quality.word_vectors(docs)
    net = quality.fit(toxicity.training_rows(docs, labels, "quality"), vectors)
    got = quality.score_documents(docs, vectors, net).collect()
    assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in own) >= 0.98 * len(own)

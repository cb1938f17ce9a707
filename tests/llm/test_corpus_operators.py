import math
import random
from collections import defaultdict
from pathlib import Path

import pytest
from helpers import AWKWARD, DOCS, alike, components, docs_table, repeats, simhash
from pyspark.sql import functions as F

from graphloop.llm import components as cc
from graphloop.llm import decontam, html_extract, line_dedup, mixing
from graphloop.llm import simhash as sh


def rows(df):
    return [r.asDict() for r in df.collect()]


def words(rng, n, size=400):
    return " ".join(f"w{rng.randint(0, size)}" for _ in range(n))


# SimHash


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [(i, words(rng, rng.randint(1, 120))) for i in range(120)]
    for k in range(200, 260):  # near copies of a few long texts
        w = words(random.Random(k % 3), 700).split()
        w[rng.randrange(len(w))] = "changed"
        texts.append((k, " ".join(w)))
    texts += [(1000 + (i or 0), t) for i, t in AWKWARD if i != 7]
    got = rows(sh.near_duplicates(docs_table(spark, texts, extra=True)))
    prints = [(i, simhash(t)) for i, t in texts]
    want = components(prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in prints}
    assert len(set(want.values())) < len(want) - 30


def test_similar_texts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [(i, words(rng, rng.randint(1, 150), 4000)) for i in range(60)]
    for k in range(100, 190):  # edited copies, some of them near the limit on either side
        w = words(random.Random(k % 9), 150, 4000).split()
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 8))):
            w[rng.randrange(len(w))] = f"c{k}"
        texts.append((k, " ".join(w)))
    half = words(random.Random(77), 120, 4000)  # a passage that many texts share
    texts += [(300 + k, f"{half} {words(rng, 40, 4000)}") for k in range(30)]
    texts += [(1000 + (i or 0), t) for i, t in AWKWARD if i != 7]
    got = rows(sh.near_duplicates(docs_table(spark, texts, extra=True), similarity=0.8))
    want = components([(i, simhash(t)) for i, t in texts], alike=alike(dict(texts), 0.8))
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(got) == len(texts) and len(set(want.values())) < len(texts) - 50


def test_chains_inside_crowded_buckets_lose_no_link(spark):
    rng = random.Random(5)
    base, texts, ids = words(rng, 200, 4000).split(), [], iter(rng.sample(range(5000), 240))

    def edited(w, n):
        at = rng.randrange(len(w) - n)
        return [*w[:at], *words(rng, n, 4000).split(), *w[at + n :]]

    for _ in range(120):  # edits of one text, most of them unlike each other, each with a copy that is like it
        x = edited(base, 10)
        texts += [(next(ids), " ".join(x)), (next(ids), " ".join(edited(x, 15)))]
    want = components([(i, simhash(t)) for i, t in texts], alike=alike(dict(texts), 0.8))
    assert {r["doc_id"]: r["component_id"] for r in rows(sh.near_duplicates(docs_table(spark, texts), similarity=0.8))} == want


def test_crowded_postings_lose_no_link(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    prints = {base} | {base ^ (1 << i) for i in range(64)} | {base ^ (1 << rng.randrange(16)) ^ (1 << rng.randrange(16)) ^ (1 << rng.randrange(16)) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp bigint")
    got = {frozenset((r["a"], r["b"])) for r in rows(sh.links(df))}
    ordered = list(prints)
    want = {frozenset((signed(a), signed(b))) for k, a in enumerate(ordered) for b in ordered[:k] if (a ^ b).bit_count() <= 2}
    assert got == want and len(want) > 2000
    assert {frozenset((r["a"], r["b"])) for r in rows(sh.links(df, crowded=20))} == want  # by refined postings


def test_every_two_bytes_leave_a_posting_and_blocks_lose_nothing(monkeypatch):
    from itertools import combinations

    import numpy as np

    assert all(any(not set(out) & set(c) for c in sh.CHOICES) for out in combinations(range(8), 2))
    rng = random.Random(3)
    prints = np.unique(np.array([rng.getrandbits(6) for _ in range(60)], np.uint64))
    monkeypatch.setattr(sh, "BLOCK", 7)
    got = [tuple(x) for t in sh._tally(prints) for x in t.tolist()]
    assert sorted(got) == [(a, b) for a, b in combinations(prints.tolist(), 2) if (a ^ b).bit_count() <= 2]


@pytest.mark.parametrize("original", [True, False])
def test_a_star_of_edited_copies_loses_no_pair(spark, original):
    rng = random.Random(21)
    base = words(rng, 300, 4000).split()
    texts = [(0, " ".join(base))] if original else []
    for k in range(1, 401):
        w = base[:]
        for at in rng.sample(range(300), rng.randint(3, 8)):
            w[at] = f"e{k}x{at}"
        texts.append((k, " ".join(w)))
    pairs = alike(dict(texts), 0.8)
    got = {r["doc_id"]: r["component_id"] for r in rows(sh.near_duplicates(docs_table(spark, texts), similarity=0.8))}
    assert len(pairs) > 100 and all(got[i] == got[j] for i, j in pairs)
    assert got == components([(i, simhash(t)) for i, t in texts], alike=pairs)


def test_leaders_leave_few_pairs_of_a_star(spark, monkeypatch):
    rng = random.Random(9)
    base, texts = words(rng, 200, 4000).split(), []
    for k in range(200):  # like the original, and unlike each other
        w = base[:]
        for at in rng.sample(range(200), 4):
            w[at] = f"e{k}x{at}"
        texts.append((k, " ".join(w)))
    texts.append((1000, " ".join(base)))
    kept, materialise = [], sh.materialise

    def counted(df, label):
        out = materialise(df, label)
        kept.append((label, out.count()))
        return out

    monkeypatch.setattr(sh, "materialise", counted)
    got = {r["doc_id"]: r["component_id"] for r in rows(sh.near_duplicates(docs_table(spark, texts), similarity=0.8))}
    assert got == components([(i, simhash(t)) for i, t in texts], alike=alike(dict(texts), 0.8))
    assert sum(n for label, n in kept if label == "pairs") < 5 * len(texts)


def test_near_duplicates_of_repeated_and_no_rows(spark):
    got = rows(sh.near_duplicates(docs_table(spark, AWKWARD)))
    assert len(got) == len(AWKWARD) and {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1} and {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert sh.near_duplicates(docs_table(spark, [])).count() == 0


def test_similar_texts_of_odd_and_no_rows(spark):
    df = docs_table(spark, [*AWKWARD, *AWKWARD, (9, "SAME text here for all of them to see. Again and again.")])
    got = rows(sh.near_duplicates(df, similarity=0.8))
    assert len(got) == 2 * len(AWKWARD) + 1 and {r["component_id"] for r in got if r["doc_id"] in (6, 7, 9)} == {6}
    assert sh.near_duplicates(df.limit(0), similarity=0.8).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in rows(cc.components(links))}
    assert got == dict.fromkeys(range(61), 0) | {100: 100, 101: 100}


def test_components_plan_one_step_at_a_time(spark, monkeypatch):
    """The driver plans a query again after each of its shuffles, so none repeats its input beyond the two sides of a join."""
    reads, write = [], cc.materialise
    monkeypatch.setattr(cc, "materialise", lambda df, label: reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")) or write(df, label))
    rng = random.Random(8)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500, i) for i in range(501, 560)] + [(None, 1), (7, None), (9, 9)]
    got = {r["node"]: r["component"] for r in rows(cc.components(spark.createDataFrame(pairs, "a long, b long")))}
    whole = [{a, b} for a, b in pairs if a is not None and b is not None and a != b]
    for p in list(whole):
        met = [s for s in whole if s & p]
        whole = [s for s in whole if not s & p] + [set().union(*met)]
    assert got == {x: min(s) for s in whole for x in s}
    assert max(reads) == 2


# Substring dedup


def test_repeats_equal_brute_force(spark):
    rng = random.Random(6)
    sentences = [words(rng, rng.randint(1, 14)).capitalize() + rng.choice([". ", "! ", "\n", ".\n", "...\n\n", " ?! "]) for _ in range(60)]
    texts = [(100 + i, "".join(rng.choices(sentences, k=rng.randint(0, 25)))) for i in range(60)] + AWKWARD + [(100, "another text of the same number.\n" + sentences[3])]
    df = docs_table(spark, texts, extra=True)
    want = repeats(texts, line_dedup.PASSAGE)
    found = sorted((r["doc_id"], [(s["start"], s["end"]) for s in r["spans"]]) for r in rows(line_dedup.repeats(df)))
    assert found == sorted((i, s) for (i, _), s in want.items()) and len(want) > 40
    left = rows(line_dedup.remove(df))
    assert len(left) == len(texts) and set(left[0]) == set(df.columns)  # the clashing column is replaced
    for r in left:
        r["text"] = r["text"], r["removed_spans"] and [(s["start"], s["end"]) for s in r["removed_spans"]]
    cut = [(i, (t and line_dedup.cut(t, [{"start": s, "end": e} for s, e in want.get((i, t), [])]), want.get((i, t)))) for i, t in texts]
    assert sorted(map(repr, cut)) == sorted(repr((r["doc_id"], r["text"])) for r in left)


def test_what_goes_stays_elsewhere(spark):
    rng = random.Random(16)
    sentences = [words(rng, rng.randint(1, 9), 60) + ". " for _ in range(25)]
    texts = [(i, "".join(rng.choice(sentences) + rng.choice(["", "", "\n"]) for _ in range(rng.randint(5, 20)))) for i in range(50)]
    left = rows(line_dedup.remove(docs_table(spark, texts)))
    plain = lambda ts: {" ".join(p.split()) for t in ts for p in t.replace("\n", ".").split(".") if p.strip()}
    assert plain(t for _, t in texts) == plain(r["text"] for r in left) and sum(len(r["text"]) for r in left) < 0.5 * sum(len(t) for _, t in texts)


def test_lines_of_any_length_go_and_sentences_alone_stay(spark):
    texts = [("a", "Yes.\nOne more thing. Short one. The end of it"), ("b", "Clean start here.\nyes.\nShort one. And another end"), ("c", "Nothing of it")]
    df = spark.createDataFrame(texts, "name string, body string")
    got = {r["name"]: r for r in rows(line_dedup.repeats(df, "body", "name"))}
    assert set(got) == {"b"} and [tuple(s) for s in got["b"]["spans"]] == [(18, 23)] and got["b"]["first_ids"] == ["a"]
    assert {r["name"]: r["body"] for r in rows(line_dedup.remove(df, "body", "name", spans=None))} == dict(texts) | {"b": "Clean start here.\nShort one. And another end"}


def test_units_are_made_once(spark):
    plan = line_dedup.removed(docs_table(spark, AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_passage_inside_lines_is_found(spark):
    passage = "The first long sentence of the passage stands here today. The second long sentence of it follows right after. A third one ends what repeats across documents, and a fourth is not far. It ends so."
    texts = [(1, f"Clean words begin, {passage} and other words end."), (2, f"Quite another start, {passage} and a different end."), (3, "Nothing in this clean text repeats at all anywhere.")]
    got = {r["doc_id"]: r for r in rows(line_dedup.repeats(docs_table(spark, texts)))}
    assert set(got) == {2} and got[2]["first_ids"] == [1]
    gone = "".join(texts[1][1][s["start"] : s["end"]] for s in got[2]["spans"])
    assert "second long sentence" in gone and "A third one" in gone and "different end" not in gone
    assert line_dedup.repeats(docs_table(spark, [])).count() == 0 and line_dedup.remove(docs_table(spark, [])).count() == 0


# Decontamination


def exhaustive(index, terms):
    """Scores of all items by plain addition over the postings of distinct terms."""
    score = defaultdict(float)
    for t in terms:
        for d, x in zip(*index.postings[t][:2], strict=True):
            score[d] += x
    return score


@pytest.mark.parametrize("block", [1, 3, 8, 64])
def test_bm25_search_equals_exhaustive_scores(monkeypatch, block):
    rng = random.Random(9)
    monkeypatch.setattr(decontam, "BLOCK", block)
    items = [(i, words(rng, rng.randint(3, 60), 150) + ".") for i in range(60)]
    index = decontam.Index(items)
    for _ in range(30):
        terms = sorted({index.term[w] for w in words(rng, 90, 150).encode().split() if w in index.term})
        for least in (0.05, 0.4, 0.7):
            want = {d: s for d, s in exhaustive(index, terms).items() if s >= least}
            got = dict(index.search(terms, least))
            assert got.keys() == want.keys() and all(math.isclose(got[d], want[d]) for d in want)


def test_search_skips_most_items(monkeypatch):
    rng = random.Random(19)
    index = decontam.Index([(i, words(rng, 40, 600) + ".") for i in range(2000)])
    scored = [0]
    terms = [index.term[w] for w in sorted({w for w in words(rng, 60, 600).encode().split() if w in index.term})]
    want = exhaustive(index, terms)
    monkeypatch.setattr(decontam, "fsum", lambda xs: [scored.__setitem__(0, scored[0] + 1), math.fsum(xs)][1])
    assert set(dict(index.search(terms, 0.3))) == {d for d, s in want.items() if s >= 0.3}
    assert scored[0] < 0.1 * len(want)


def plain_matches(items, text):
    """The whole query by brute force: every passage against every item, then the shares of shingles."""
    whole = decontam.Statistics()
    for _, t in items:
        whole.add(t)
    w, half, found = decontam.words_of(text), max(decontam.WINDOW, whole.longest), {}
    for start in range(0, max(1, len(w) - half), half) if w else []:
        passage = w[start : start + 2 * half]
        for i, t in items:
            own = decontam.words_of(t)
            if not own:
                continue
            score = math.fsum(x for word, x in whole.impacts(own).items() if word in set(passage))
            share = [len(x & decontam.shingles(passage, n)) / len(x) if x else 1.0 for n, x in decontam.parts_of(t)]
            if score >= decontam.THRESHOLD - 1e-9 and share[0] >= decontam.QUESTION and share[1] >= decontam.ANSWER:
                found[i] = max(found.get(i, (0,)), (score, *share))
    return found


def edited_items(rng, n):
    items = [(i, words(rng, rng.randint(12, 60), 900).capitalize() + ". " + words(rng, rng.randint(1, 9), 900) + ".") for i in range(n)]
    texts = []
    for k in range(3 * n):
        w = items[k % n][1].split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"w{rng.randint(0, 900)}"
        texts.append((k, words(rng, rng.randint(0, 300), 900) + " " + " ".join(w) + " " + words(rng, rng.randint(0, 200), 900)))
    return items, texts


def test_whole_query_equals_brute_force(monkeypatch):
    items, texts = edited_items(random.Random(11), 40)
    monkeypatch.setattr(decontam, "SLICE", 2000)
    index, n = decontam.Index(items), 0
    for _, t in texts:
        want = plain_matches(items, t)
        got = {i: (s, q, a) for i, s, q, a, _ in index.match(t)}
        assert got.keys() == want.keys() and all(math.isclose(got[i][0], want[i][0]) for i in want)
        n += len(want)
    assert 40 < n < 119


def test_parts_of_an_index_change_no_row(spark):
    items, texts = edited_items(random.Random(12), 60)
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in texts], "doc_id string, text string")  # identifiers of other types
    bench = spark.createDataFrame([(f"i{i}", t) for i, t in items], "item_id string, text string")
    whole, cut = (sorted(tuple(r) for r in decontam.contaminated(docs, bench, part=n).collect()) for n in (10**6, 300))
    assert whole == cut and len(whole) > 60


def test_memory_does_not_grow_with_a_text():
    import tracemalloc

    rng = random.Random(13)
    index = decontam.Index([(i, words(rng, 40, 3000) + ".") for i in range(200)])
    text = words(rng, 1000, 3000) + " "
    peaks = []
    for n in (200, 800):
        long = decontam.words_of(text * n)
        size = sum(map(len, long)) + 57 * len(long)
        tracemalloc.start()
        index.match(text * n)
        peaks.append(tracemalloc.get_traced_memory()[1] - size)
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 60_000_000


def test_planted_items_are_found_and_clean_texts_stay(spark):
    rng = random.Random(10)
    items = [(i, words(rng, rng.randint(12, 70), 3000).capitalize() + ". " + words(rng, rng.randint(1, 9), 3000) + ".") for i in range(40)] + [(98, None), (99, "")]
    clean = [(i, words(rng, rng.randint(0, 900), 3000)) for i in range(60)]
    planted = [(1000 + k, words(rng, rng.randint(0, 700), 3000) + " " + items[k][1] + " " + words(rng, rng.randint(0, 300), 3000)) for k in range(40)]
    question_only = [(2000, items[0][1].split(". ")[0] + ". " + words(rng, 40, 3000))]
    docs = docs_table(spark, clean + planted + question_only + AWKWARD, extra=True)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontam.contaminated(docs, bench))}
    assert got == {(1000 + k, k) for k in range(40)}
    assert {(r["doc_id"], r["item_id"]) for r in rows(decontam.contaminated(docs, bench, part=90))} == got
    kept = [r["doc_id"] for r in rows(decontam.decontaminate(docs, bench))]
    assert len(kept) == len(clean) + 1 + len(AWKWARD) and not set(kept) & {d for d, _ in got}
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0


# Mixing


def test_raking_meets_all_marginals():
    mass = {(s, lang, t): 100.0 + 17 * i + 5 * j + 3 * k for i, s in enumerate("ab") for j, lang in enumerate("xy") for k, t in enumerate("pq")}
    targets = mixing.Targets({"a": 1, "b": 3}, {"x": 0.4, "y": 0.6}, {"p": 2, "q": 2}, budget=0.3)
    p = mixing.rake(mass, targets)
    total = sum(mass[c] * p[c] for c in mass)
    assert math.isclose(total, 0.3 * sum(mass.values()), rel_tol=1e-6)
    for d, named in enumerate((targets.source, targets.lang, targets.topic)):
        for k, want in named.items():
            assert math.isclose(sum(mass[c] * p[c] for c in mass if c[d] == k) / total, want / sum(named.values()), rel_tol=1e-6)
    assert all(0 <= x <= 1 for x in p.values())
    full = mixing.rake({("a", "x", "p"): 1.0, ("b", "x", "p"): 1000.0}, mixing.Targets({"a": 1, "b": 1}, {"x": 1}, {"p": 1}, budget=0.5))
    assert full["a", "x", "p"] == 1.0 and mixing.rake({}, targets) == {}


def plain_rake(mass, source, lang, topic, budget):
    """Raking over a dense array, some rounds of it, for cells that never fill up."""
    import numpy as np

    axes = [sorted({c[d] for c in mass}) for d in range(3)]
    m = np.zeros([len(x) for x in axes])
    for c, v in mass.items():
        m[tuple(x.index(k) for x, k in zip(axes, c, strict=True))] = v
    have, want = m * budget, budget * m.sum()
    for _ in range(3000):
        for d, named in enumerate((source, lang, topic)):
            goal = np.array([named[k] for k in axes[d]], float)
            sums = have.sum(tuple(i for i in range(3) if i != d))
            shape = [-1 if i == d else 1 for i in range(3)]
            have = have * (want * goal / goal.sum() / sums).reshape(shape)
    return {c: float(have[tuple(x.index(k) for x, k in zip(axes, c, strict=True))] / v) for c, v in mass.items()}


TOPICS = {"law": "a Licence", "technology": "some PASSWORD", "commerce": "5 $", "contact": "me@x", "news": "the President", "general": "plain"}


def plain_topic(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return next((t for t, own in mixing.TOPIC_WORDS.items() if any(w in low for w in own)), "general")


@pytest.mark.parametrize("named", [False, True])
def test_mix_equals_brute_force(spark, named):
    import hashlib

    rng = random.Random(12)
    data = [(i, f"{rng.choice(list(TOPICS.values()))} " + words(rng, rng.choice([5, 60, 300])), rng.choice(["en", "en", "de", None]), rng.choice(["web", "web", "web", "books", None]), 0) for i in range(600)] + [(None, "x", "en", "web", 1), (7, None, "en", "web", 0), (7, None, "en", "web", 0)]
    targets = mixing.Targets({"web": 3, "other": 2}, {"en": 2, "other": 1}, {"law": 2, "general": 3, "other": 4}, budget=0.1) if named else None
    df = spark.createDataFrame(data, DOCS)
    group = lambda x, d: (x or "other") if targets is None else x if x in d and x != "other" else "other"
    cell = lambda r: (group(r[3], targets and targets.source), group(r[2], targets and targets.lang), group(plain_topic(r[1]), targets and targets.topic))
    mass = defaultdict(float)
    for r in data:
        mass[cell(r)] += len((r[1] or "").split())
    mass = {c: v for c, v in mass.items() if v}
    if targets is None:
        power = lambda d: {k: sum(v for c, v in mass.items() if c[d] == k) ** 0.7 for k in {c[d] for c in mass}}
        targets = mixing.Targets(power(0), power(1), power(2), 0.1)
        assert {c[2] for c in mass} == set(TOPICS)
        p = plain_rake(mass, targets.source, targets.lang, targets.topic, 0.1)
        drawn, sampled = mixing.mix(df, mixing.targets_of(mass, budget=0.1)), mixing.sample(df.withColumn("topic", F.lit("clash")), mixing.targets_of(mass, budget=0.1))
    else:
        p = plain_rake(mass, targets.source, targets.lang, targets.topic, 0.1)
        drawn, sampled = mixing.mix(df, targets), mixing.sample(df.withColumn("topic", F.lit("clash")), targets)
    assert max(p.values()) < 1
    draw = lambda i: int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:8], 16) / 2**32
    want = sorted((str(r[0]), p.get(cell(r), 0), draw(r[0]) < p.get(cell(r), 0)) for r in data)
    got = sorted((str(r["doc_id"]), r["probability"], r["kept"]) for r in rows(drawn))
    assert len(got) == len(data) and all(x[0] == y[0] and x[2] == y[2] and math.isclose(x[1], y[1], abs_tol=1e-6) for x, y in zip(got, want, strict=True))
    assert sorted(str(r["doc_id"]) for r in rows(sampled)) == [i for i, _, kept in want if kept] and any(k for _, _, k in want)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.sample(df.limit(0)).count() == 0


# HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><header><p>Site</p></header><div id="cookie-notice">Cookies</div><div class="ad">Buy</div>
<article><h1>Title {n}</h1><p>One &amp; two <b>three</b>{n}<br>four<p>Five<form><input value="x">Sign up</form></p><aside>Side</aside></article>
<section class="comments"><p>Reader says {n}</p></section><footer>&copy; site</footer></body></html>"""


def test_article_without_the_rest(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.com/{i}", PAGE.format(n=i), "clash") for i in range(12)], "page_id bigint, url string, html string, row string")
    got = {r["page_id"]: r for r in rows(html_extract.extract(pages))}
    assert {i: r["text"] for i, r in got.items()} == {i: f"Title {i}\nOne & two three{i} four\nFive" for i in range(12)}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_style_tree_drops_what_a_host_repeats(spark):
    plain = "<div class='top'>Welcome to our site</div><div class='x1'><p>Story {n} goes here</p><p>More of {n}</p></div><div class='x2'>Read on tomorrow</div>"
    data = [(i, "http://one.com/" + str(i), plain.format(n=i)) for i in range(8)] + [(100 + i, "http://one.com/copy", plain.format(n=3)) for i in range(20)] + [(50, "http://alone.com/", plain.format(n=1))]
    got = {r["page_id"]: r["text"] for r in rows(html_extract.extract(spark.createDataFrame(data, "page_id bigint, url string, html string")))}
    assert got[2] == "Story 2 goes here\nMore of 2" and got[105] == got[3] == "Story 3 goes here\nMore of 3"
    assert got[50].startswith("Welcome")
    same = spark.createDataFrame([(i, "http://s.com", f"<p>all the same</p><!-- {i} -->") for i in range(9)], "page_id bigint, url string, html string")
    assert {r["text"] for r in rows(html_extract.extract(same))} == {"all the same"}


def text_of(html, known=None):
    elements, blocks, _ = html_extract.parse_page(html)
    return "\n".join(html_extract.select(elements, blocks, known or {}))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("just text", "just text"), ("<script>x", ""), ("<!-- never closed <p>a</p>", ""), ("a<b", "a<b"), ("<p>1 &lt; 2 &#8364;&nbsp;x", "1 < 2 € x"), ("<ul><li>a<li>b</ul>c", "a\nb\nc"), ("<p a='>'>x</p>", "x"), ("<p a=\"unclosed>x</p>", "x"), ("<div hidden>no</div><p>yes", "yes"), ("<table><tr><td>1<td>2</table>", "1\n2"), ("<p>x</p>" * 3, "x\nx\nx"), ("<b>" * 5000 + "deep", "deep"),
        ('<p><img alt="a>b' + "x" * 9000 + '">text</p>', "text"), ("<head><title>t</title><p>text", "text"), ("<!-->a", "a"), ("<!DOCTYPE html", ""), ("<main><p>x y</p><aside>no</aside></main><p>out</p>", "x y"), ("<article>" + "<i>" * 30 + "a" + "</b>" * 30, "a"),
    ],
)
def test_odd_pages(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize("name", ["has-sidebar", "ad-free", "theme-dark comments-enabled", "sidebar", "widget promo"])
def test_an_article_stays_whatever_stands_around_it(name):
    assert text_of(f'<div class="{name}"><div><article><p>All of it</p></article></div></div><div class="ad">Buy</div>') == "All of it"


def test_what_is_the_article():
    story = "word " * 59 + "word"
    assert text_of(f'<div class="content"><p>{story}</p></div><article><p>Teaser</p></article>') == story
    comments = '<section class="comments"><article><p>Me too</p></article></section>'
    assert text_of(f"<article><p>A story is here.</p></article>{comments}") == "A story is here."
    assert text_of(f'<div class="content"><p>A story is here.</p></div>{comments}') == "A story is here."
    assert text_of("<article><p>One</p></article><div class='related-posts'>Two</div><article><p>Three</p></article>") == "One\nThree"


@pytest.mark.parametrize("page", ["<b>{}</i>", "<b>{}x<hr>", "<div>{}</b>", "<b<{}", "<a ='>{}", '<i><div>{}<b>{}</i>', "<p><b>{}", "<table><tr><td>{}x", '<a x="{}', "<a href={}>", "<!{}", "<div>{}x"])
def test_parsing_is_linear(page):
    import time

    def took(n):
        parts = page.split("{}")
        html = "".join(p * n for p in parts)
        best = 1e9
        for _ in range(2):
            at = time.perf_counter()
            text_of(html)
            best = min(best, time.perf_counter() - at)
        return best

    assert took(24_000) < 16 * took(4000) + 0.05  # six times as long; a quadratic one takes 36 times


HOST_PAGE = "<div class='top'>Welcome to our site</div><div class='box'><h2>Latest</h2><ul><li>One link</li><li>Another</li></ul></div><div class='x1{x}'><p>Story {n} goes here</p><p>More of {n}</p><p class='tail'>Tell your friends</p></div><div class='low'>Read on tomorrow</div>"


def test_style_tree_equals_brute_force(spark):
    from helpers import branch_importance, style_tree

    html = lambda i: HOST_PAGE.format(n=i, x="" if i % 5 else " wide") if i % 7 else PAGE.format(n=i)
    data = [(i, f"http://h{i % 3}.com/{i}", html(i)) for i in range(60)]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string")
    parsed = {i: html_extract.parse_page(t) for i, _, t in data}
    want = style_tree([(i % 3, n) for i, (_, _, n) in parsed.items()], html_extract.DOUBT)
    host = {r["host"]: r["page_id"] % 3 for r in rows(html_extract.parse(df))}
    tree = {(host[r["host"]], r["node"] % (1 << 64)): (r["content"], r["style"]) for r in rows(html_extract.style_tree(html_extract.parse(df)))}
    assert tree.keys() == want.keys() and all(abs(tree[k][0] - want[k][0]) < 1e-5 and abs(tree[k][1] - want[k][1]) < 1e-5 for k in want)
    texts = {r["page_id"]: r["text"] for r in rows(html_extract.extract(df))}
    changed = 0
    for i, (elements, blocks, _) in parsed.items():
        known = {n: want[i % 3, n] for _, n, _ in elements}
        most = html_extract.branches(elements, blocks, known)
        assert all(abs(most[e] - branch_importance(e, elements, blocks, known, html_extract.SHARE)[1]) < 1e-9 for e in range(len(elements)))
        assert texts[i] == "\n".join(html_extract.select(elements, blocks, known))
        changed += texts[i] != "\n".join(html_extract.select(elements, blocks, {}))
    assert changed > 40 and texts[1] == "Story 1 goes here\nMore of 1"


def test_texts_of_pages_are_not_kept_beside_their_shuffle(spark, monkeypatch):
    kept, materialise = [], html_extract.materialise
    monkeypatch.setattr(html_extract, "materialise", lambda df, label: kept.append(materialise(df, label)) or kept[-1])
    rng = random.Random(6)
    data = [(i, f"http://h{i % 3}.com/{i}", f"<nav><p>{words(rng, 200, 10**9)}</p></nav><article><p>{words(rng, 400, 10**9)}</p></article>") for i in range(40)]
    df = spark.createDataFrame([*data, data[3]], "page_id bigint, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in rows(html_extract.extract(df)))
    assert got == sorted((i, text_of(html)) for i, _, html in [*data, data[3]]) and len(got) == 41
    sizes = [sum(p.stat().st_size for p in Path(t._scratch_path).rglob("*.parquet")) for t in kept]
    assert sizes and sum(sizes) < 0.1 * sum(len(html) for _, _, html in data)
    elements, blocks, _ = html_extract.parse_page(PAGE.format(n=1))
    assert html_extract._text(html_extract._pack(elements, blocks), {}, html_extract.LEAST) == text_of(PAGE.format(n=1))


def test_extract_of_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, None, None), (1, "x", ""), (1, "x", "<p>a"), (1, "x", "<p>a")], "page_id bigint, url string, html string")
    assert sorted(r["text"] for r in rows(html_extract.extract(df))) == ["", "", "a", "a"]
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("item", ["Who ran? The tall man from the north ran there.", "Short question here? Yes.", "Only four words here", "One. Two three four five six seven. Eight."])
def test_items_with_short_parts_are_found(item):
    index = decontam.Index([(1, item), (2, "Quite another thing, told in other terms. And it ends so.")])
    around = "some words before it all and then more"
    assert [m[0] for m in index.match(f"{around} {item} {around}")] == [1]
    assert index.match(f"{around} {around}") == []

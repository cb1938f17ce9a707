"""Plain versions of the corpus operators' contracts and small tables with awkward rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_table(spark, texts, extra: bool = False):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # columns whose names clash with what operators make
        from pyspark.sql import functions as F

        for c in ("n_words", "score", "labels", "fp", "_text", "digest", "kept", "digits", "row", "host", "lang_pred", "probability", "topic", "n_tokens", "removed_spans", "item_id"):
            df = df.withColumn(c, F.lit("x"))
    return df


AWKWARD = [(1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, "word " * 30_000), (6, "same text here for all of them to see. Again and again."), (7, "same text here for all of them to see. Again and again."), (7, "same text here for all of them to see. Again and again."), (None, "no identifier at all in this row."), (8, "\x00\x0b x‐y é 日本 \U0001f389")]


def simhash(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def alike(texts, similarity, size=5):
    """All pairs of identifiers whose sets of word shingles have that Jaccard similarity or more; texts: by identifier."""
    sets, holders, out = {}, defaultdict(list), []
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        for s in sets[i]:
            holders[s].append(i)
    for i, own in sets.items():
        shared = Counter(j for s in own for j in holders[s] if j > i)
        out += [(i, j) for j, n in shared.items() if n >= similarity * (len(own) + len(sets[j]) - n) - 1e-9]
    return out


def components(ids_and_prints, bits=2, alike=()):
    by = defaultdict(list)
    for i, f in ids_and_prints:
        by[f].append(i)
    prints = list(by)
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(prints):
        for b in prints[k + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    own = dict(ids_and_prints)
    for i, j in alike:
        parent[find(own[i])] = find(own[j])
    least = {}
    for f in prints:
        r = find(f)
        least[r] = min([*by[f], least.get(r, min(by[f]))])
    return {i: least[find(f)] for i, f in ids_and_prints}


def quality_counts(text):
    t = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def repeats(rows, passage):
    """Per (identifier, text): the spans that go, by the rule of earliest occurrences of lines and of runs of sentences."""
    first, units = {}, defaultdict(list)
    for i, t in set(rows):
        at = 0
        for line in (t or "").splitlines(keepends=True) if "\n" in (t or "") else [t or ""]:
            pieces = [("line", at, line)]
            s = at
            for piece in re.findall(r"[^.!?]+[.!?]*|[.!?]+", line.removesuffix("\n")) or [""]:
                pieces.append(("sentence", s, piece))
                s += len(piece)
            kind, s, piece = pieces[-1]
            pieces[-1] = kind, s, piece + line[len(line.removesuffix("\n")) :]
            for kind, s, piece in pieces:
                if norm := " ".join(piece.lower().split()):
                    units[i, t].append((kind, s, s + len(piece), norm))
            at += len(line)
        for kind, s, _, norm in units[i, t]:
            here = (i is not None, i if i is not None else 0, s)
            first[kind, norm] = min(first.get((kind, norm), here), here)
    out = {}
    for (i, t), own in units.items():
        if i is None:
            continue
        spans = [(s, e) for kind, s, e, norm in own if kind == "line" and first[kind, norm] != (True, i, s)]
        run = []
        for kind, s, e, norm in [u for u in own if u[0] == "sentence"] + [("end", 0, 0, "")]:
            if kind == "sentence" and first[kind, norm] != (True, i, s):
                run.append((s, e, len(norm.split())))
                continue
            if sum(x[2] for x in run) >= passage:
                spans += [x[:2] for x in run]
            run = []
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        if merged:
            out[i, t] = merged
    return out


def style_tree(pages, doubt):
    """(content, presentation) by (host, node) of the host's distinct pages. pages: (host, nodes), nodes as parse_page gives them."""
    import math

    distinct = defaultdict(set)
    for host, nodes in pages:
        distinct[host].add(tuple(nodes))

    def scaled(values):
        n, h = len(values), 0.0
        for c in Counter(values).values():
            h -= c / n * math.log(c / n)
        return ((h / math.log(n) if n > 1 else 1.0) * n + doubt) / (n + doubt) if n else 1.0

    out = {}
    for host, own in distinct.items():
        for node in {n for p in own for n, _, _ in p}:
            here = [(c, s) for p in own for n, c, s in p if n == node]
            out[host, node] = scaled([c for c, _ in here if c]), scaled([s for _, s in here])
    return out


def branch_importance(e, elements, blocks, known, share):
    """(composite importance of element e, the greatest in its branch), by recursion."""
    parts = [branch_importance(c, elements, blocks, known, share) for c in range(len(elements)) if elements[c][0] == e]
    content, style = known.get(elements[e][1], (1.0, 1.0))
    own = [p[0] for p in parts] + ([content] if any(b[0] == e for b in blocks) else [])
    mean = sum(own) / len(own) if own else 1.0
    k = share ** len(parts)
    at = (1 - k) * style + k * mean if parts else mean
    return at, max([at, *(p[1] for p in parts)])

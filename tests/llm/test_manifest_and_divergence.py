"""The Merkle manifest and the divergence audit against plain restatements."""

import re
import zlib

from pyspark.sql import functions as F

from tests.llm import brute
from tidewatch.llm import divergence, merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(row, text):
    values = [*(row[c] for c in FIELDS[:-1]), text]
    return brute.sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests, arity):
    """Root, and for every leaf its (ahead, after) steps."""
    steps, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // arity * arity
            steps[i].append(("".join(level[run:p]), "".join(level[p + 1: run + arity])))
        level = [brute.sha("".join(level[i: i + arity])) for i in range(0, len(level), arity)]
        at = [p // arity for p in at]
    return level[0], steps


def manifest(rows, arity):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), i) for i, r in enumerate(rows) if r["source"] == s) for s in sources}
    trees = {s: tree([x[2] for x in of[s]], arity) for s in sources}
    root, tops = tree([trees[s][0] for s in sources], arity)
    out = []
    for s, top in zip(sources, tops):
        for (_, _, digest, i), own in zip(of[s], trees[s][1]):
            r, steps = rows[i], own + top
            fold = digest
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                fold = leaf(r, r["text"].replace("\n", ""))
            for ahead, after in steps:
                fold = brute.sha(ahead + fold + after)
            out.append((r["doc_id"], digest, trees[s][0], root, brute.sha("".join(a + b for a, b in steps)), fold, fold == root))
    return sorted(out, key=repr)


def test_manifest(odd_docs):
    rows = [r.asDict() for r in odd_docs.collect()]
    for arity in (3, 2):
        assert sorted(map(tuple, merkle.manifest(odd_docs, arity).collect()), key=repr) == manifest(rows, arity)


def test_manifest_of_one_row_and_of_lone_sources(docs):
    one = docs.where("doc_id = 1")
    got = merkle.manifest(one).collect()[0]
    assert got["leaf"] == got["subroot"] == got["root"] and got["proof_sha256"] == brute.sha("")
    alone = docs.limit(5).withColumn("source", F.concat(F.lit("s"), F.col("doc_id").cast("string")))
    assert {r["leaf"] == r["subroot"] for r in merkle.manifest(alone).collect()} == {True}


def audit(rows):
    kind = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, docs, groups = {}, {}, set()
    for r in rows:
        lang, source, text = r["lang"] or "", r["source"] or "", (r["text"] or "").translate(brute.A_TO_Z)
        groups.add((lang, source))
        for t in kind.findall(text):
            count[lang, source, t] = count.get((lang, source, t), 0) + 1
        for t in set(kind.findall(text)):
            docs[lang, t] = docs.get((lang, t), 0) + 1
    out = []
    for lang in {g for g, _ in groups}:
        kept, sources = [t for (g, t), n in docs.items() if g == lang and n >= 3], [s for g, s in groups if g == lang]
        n = {s: {t: count.get((lang, s, t), 0) for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in n.items()}
        f = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            parts = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s],
                     "term": [(f(p[s][t], p[None][t]), t) for t in kept if n[s][t] and p[s][t] > p[None][t]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked[: 200 if part == "term" else None])]
    return sorted(out)


def test_audit(odd_docs, monkeypatch):
    more = odd_docs.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 11).cast("string"))).unionByName(odd_docs.withColumn("lang", F.lit(None).cast("string"))).unionByName(
        odd_docs.where("text = 'one'").withColumn("lang", F.lit("zz")))
    rows = [r.asDict() for r in more.collect()]
    for block in (4096, 16):
        monkeypatch.setattr(divergence, "TERM_BLOCK", block)
        assert sorted(map(tuple, divergence.audit(more).collect())) == audit(rows)


def test_empty_tables(no_docs):
    assert divergence.audit(no_docs).collect() == [] and merkle.manifest(no_docs).collect() == []

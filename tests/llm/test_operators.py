"""Each operator against a plain restatement, on awkward rows, on repeated rows and on an empty table."""

import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewatch.llm import bpe, debruijn, fingerprints, graph, jaccard_join, line_templates, merkle, minhash_dedup, mixing, pii, quality_crf, repetition, sharding


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, texts, size):
    got = by_id(minhash_dedup.near_duplicates(docs, size))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute.components(texts, size)
    assert all(r["kept"] == (r["component_id"] == d) for d, r in got.items())


def test_one_of_each_keeps_columns(docs, texts):
    kept = minhash_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in brute.components(texts, 5).items() if c == d}


def kept_of(df):
    return sorted((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in df.collect())


def test_one_of_each_keeps_one_row_of_every_group(odd_docs):
    rows = [(r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    groups, want = brute.components(dict(enumerate(t for _, _, t in rows)), 5), []
    for g in {c for _, c in groups.values()}:
        members = [rows[i] for i, (_, c) in groups.items() if c == g]
        want.append(min(members, key=lambda r: (r[0], r[1] or 0)))
    assert kept_of(minhash_dedup.one_of_each(odd_docs)) == sorted(want)


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.components(chain.unionByName(spark.createDataFrame([(500, 501), (501, 502)], "a bigint, b bigint"))).collect()
    assert len(got) == 203 and {r["component"] for r in got if r["node"] <= 200} == {next(iter(r["component"] for r in got if r["node"] == 1))}
    assert len({r["component"] for r in got}) == 2


def test_substring_dedup(docs, texts):
    got = by_id(debruijn.removal_report(docs))
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in got.items()} == brute.removed(texts)


def test_repetition(docs, texts):
    got = by_id(repetition.repetition_rules(docs))
    for d, text in texts.items():
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.repetition(text)
        assert not (r["kept"] and r["base_failed"])
        assert r["longest_repeat"] == brute.longest_repeat(text)


def test_personal_data(docs, texts):
    got = by_id(pii.personal_data(docs))
    for d, text in texts.items():
        spans = brute.base_spans(text)
        flat = [s for kind in spans for s in kind]
        r = got[d]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(s) for s in spans]
        assert r["base_sha256"] == brute.sha(",".join(flat)) and set(flat) <= set(r["spans"].split(","))
    assert sum(r["n_iban"] for r in got.values()) == 1
    assert sum(r["n_ssn"] for r in got.values()) == 2  # both have a context word among the 40 characters before them


def test_patterns_stay_linear_on_long_runs(spark):
    rows = [(1, "a" * 200_000 + " @"), (2, "7" * 200_000 + " 1.2"), (3, "a@" + "b." * 20_000 + "c")]
    got = by_id(pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [got[i]["n_email"] for i in (1, 2, 3)] == [0, 0, 1]


def test_spans_end_where_the_number_ends_and_see_the_words_before_them(spark):
    rows = [(1, "pay ES91 2100 0418 4502 0005 1332 EUR now"), (2, "SSN 123-45-6789, 234-56-7890"), (3, "XX91 2100 0418 4502 0005 1332"), (4, "éé iban DE89370400440532013000ABC")]
    got = by_id(pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got[1]["spans"].split(",")[-1] == "iban:4:33"
    assert got[2]["n_ssn"] == 2 and "ssn:17:28" in got[2]["spans"]
    assert got[3]["n_iban"] == got[4]["n_iban"] == 0


def test_very_many_matches_in_one_text(spark):
    text = "mail x1@y.de and a.b@c.org, " * 20_000
    got = by_id(pii.personal_data(spark.createDataFrame([(1, text)], "doc_id bigint, text string")))[1]
    assert got["n_email"] == 40_000 and got["base_sha256"] == brute.sha(",".join(x for kind in brute.base_spans(text) for x in kind))


def test_fingerprints(docs, texts):
    got, ids = by_id(fingerprints.fingerprint_report(docs)), sorted(texts)
    off, seen = [], {}
    for i, d in enumerate(ids):
        text, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == brute.sha(edited)
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        a, b = brute.shingles_cased(text, 5), brute.shingles_cased(edited, 5)
        off.append(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0))
        assert 0 <= r["near_next"] <= 1
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.2


def test_line_templates(docs, texts):
    got = by_id(line_templates.drop_templates(docs))
    kept = {d: r["text"] for d, r in got.items()}
    licence = [d for d, t in texts.items() if "Licensed under" in t]
    assert [d for d in sorted(licence) if "Licensed under" in kept[d]] == [min(licence)]
    numbered = [d for d, t in texts.items() if t.startswith("Report number")]
    assert [d for d in numbered if kept[d].startswith("Report number")] == [min(numbered)]
    signed = [d for d, t in texts.items() if t.startswith("Signed by")]
    assert [d for d in signed if kept[d].startswith("Signed by")] == [min(signed)]
    assert all(len(kept[d].split("\n")) > 1 or t.count("\n") < 2 or d in licence for d, t in texts.items() if kept[d] is not None and "\n" in t and "Report" in t)


def test_line_templates_with_fields_anywhere(spark):
    posted = ["Posted by Anna on Monday in category Travel", "Posted by Bob on Friday in category Food", "Posted by Cy on Sunday in category Sport"]
    written = [f"Written by our editor {name} for the blog" for name in ("Anna Smith", "Bob Jones", "Cy Young")]
    short = [f"Filed under {topic} today" for topic in ("Travel", "Food", "Sport")]
    # Half of these have one topic: it is as frequent as a fixed word of a small template.
    skewed = [f"Sent from {place} to {name} about {topic} this week" for place, name, topic in
              [("Rome", "Ann", "Rain"), ("Oslo", "Bo", "Rain"), ("Bern", "Cid", "Rain"), ("Lima", "Dee", "Snow"), ("Kyiv", "Eve", "Wind")]]
    prose = ["It was the first of many long walks home", "It was an old and very quiet house then", "It was her brother who came back too late"]
    pairs = ["Kept with Anna on Monday in category Travel", "Kept with Bob on Friday in category Food"]
    lines = posted + written + short + skewed + prose + pairs
    docs = spark.createDataFrame([(i, f"{line}\nend", "en") for i, line in enumerate(lines)], "doc_id bigint, text string, lang string")
    again = docs.unionByName(docs.where("doc_id = 0"))
    heads = {posted[0], written[0], short[0], skewed[0], *prose, *pairs}
    for rows in (docs, again):
        kept = {r["text"].split("\n")[0] for r in line_templates.drop_templates(rows).collect() if r["text"] != "end"}
        assert kept == heads


def test_mix_meets_targets(docs, texts):
    got = mixing.mix_report(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    sizes = {d: len(brute.words(t)) for d, t in texts.items()}
    per = {}
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        s = per.setdefault((r["source_size"], r["target"]), [0, 0])
        s[0] += r["taken"]
        s[1] += r["size"]
    assert sum(t for _, t in per) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken - target) <= 1 and target <= 2 * source + 1e-9 and size == source for (source, target), (taken, size) in per.items())
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()))


def test_mix_documents_take_what_the_report_says(docs):
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    taken = {}
    for r in mixed.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(brute.words(r["text"]))
    assert taken == {r["doc_id"]: r["taken"] for r in mixing.mix_report(docs).collect() if r["taken"]}


def test_splitting_tree_keeps_quotas_and_is_hypergeometric(spark):
    quotas = spark.createDataFrame([(1, 1000), (2, 10), (3, 0), (4, 333)], "rank int, quota bigint")
    for row in mixing.split_quotas(quotas, 5).collect():
        assert len(row["starts"]) == 5 and row["starts"] == sorted(row["starts"]) and row["starts"][0] == 0
    draws = spark.range(4000).select(mixing.hypergeometric(F.lit(300), F.lit(1000), F.lit(100), mixing.unit(F.col("id").cast("string"))).alias("k"))
    mean, deviation = draws.agg(F.avg("k"), F.stddev("k")).first()
    assert mean == pytest.approx(30, abs=0.3) and deviation == pytest.approx((100 * .3 * .7 * 900 / 999) ** .5, rel=0.06)
    edges = spark.range(1).select(*[mixing.hypergeometric(F.lit(k), F.lit(n), F.lit(d), F.lit(u)) for k, n, d, u in [(0, 9, 4, .5), (9, 9, 4, .5), (3, 9, 9, .5), (3, 9, 8, .001)]]).first()
    assert list(edges) == [0, 4, 3, 2]


def test_shards(docs, texts):
    got = sharding.shard_documents(docs).collect()
    slots = {}
    for r in got:
        text = texts[r["doc_id"]]
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], sharding.SHARDS)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shard_weights(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    counts = {r["s"]: r["count"] for r in keys.select(sharding.rendezvous(F.col("k"), [1.0, 2.0, 1.0]).alias("s")).groupBy("s").count().collect()}
    assert counts[1] == pytest.approx(10_000, rel=0.05) and counts[0] == pytest.approx(5_000, rel=0.06)


def test_bpe_matches_tiktoken_and_decodes(docs, texts):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    import base64
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.rank_file().splitlines())}
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.token_report(docs))
    for d, text in texts.items():
        ids = plain.encode_ordinary(text)
        r = got[d]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text))


def test_bpe_offsets_and_pieces(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    text = "Größe 😀 and  two  blanks\n\n" * 30
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    whole_text = by_id(bpe.encode(docs, bpe.rank_file(), public.PATTERN, offsets=True))
    assert whole_text[2]["ids"] == [] and len(whole_text[1]["ids"]) == len(whole_text[1]["starts"]) == len(whole_text[1]["ends"])
    assert whole_text[1]["starts"][0] == 0 and whole_text[1]["ends"][-1] == len(text)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 20)
    pieces = list(bpe.pieces(text))
    assert "".join(p for _, p in pieces) == text and len(pieces) > 5
    coder = bpe.tokenizer(bpe.rank_file(), public.PATTERN)
    assert [i for _, p in pieces for i in coder.encode(p, add_special_tokens=False).ids] == whole_text[1]["ids"]


def test_bpe_merges_each_word_once(monkeypatch):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = bpe.rank_file()
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.tokens_of(ranks))}, special_tokens={})
    bpe.tokenizer(ranks, public.PATTERN)
    model, merged = bpe.merge_model(ranks), []
    monkeypatch.setattr(bpe, "merge_model", lambda _: type("Counted", (), {"tokenize": lambda _, word: merged.append(word) or model.tokenize(word)})())
    bpe.word_encoder.cache_clear()
    encode = bpe.word_encoder(ranks, public.PATTERN)
    # Every character, beside letters, digits and blanks: engines of another Unicode than tiktoken's must not split it.
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1 {c}" for c in every[i: i + 4096]) for i in range(0, 0x30000, 4096)]
    texts += ["qzxv'll  qzxv\n\n qzxv" * 50, "", "'", "''s 's", " \u3000 x "]
    for _ in range(2):
        encode(texts[-5:])
    assert "Ġqzxv" in merged and len(merged) == len(set(merged))
    assert [ids.tolist() for ids in encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def junk(i):
    return " ".join(f"{w}{'#*$%'[j % 4] * 3}" for j, w in enumerate(["er", "the", "in", "of", "thand"] * (3 + i % 5)))


def test_quality_separates_held_out_documents(spark, texts):
    rows = [(i, junk(i) if i % 3 == 0 else list(texts.values())[i % 25] + f" and number {i}.", "en", "s", 0) for i in range(240)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(240)] + [(5, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = by_id(quality_crf.quality_report(docs, labels))
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for d, r in got.items())
    held = [d for d, r in got.items() if r["held_out"] and d < 240]
    assert len(held) > 30 and sum(got[d]["predicted"] == int(d % 3 != 0) for d in held) >= 0.95 * len(held)
    assert got[900]["score"] == got[901]["score"] and 0 <= got[900]["score"] <= 1
    kept = quality_crf.accepted(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["predicted"]}


def test_quality_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality_crf.quality_report(docs, none).collect()} == {0.5}


def quality_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (7, 1, 0), (10, 0, 0)], "doc_id bigint, quality int, toxic int")


def test_accepted_rows_keep_columns_of_any_name(odd_docs):
    named = odd_docs.withColumn("__whole", F.lit(1)).withColumn("__score", F.lit(2)).withColumn("__0", F.lit(3))
    assert quality_crf.accepted(named, quality_labels(odd_docs.sparkSession)).columns == named.columns
    report = quality_crf.quality_report(named, quality_labels(odd_docs.sparkSession))
    assert quality_crf.accepted(named, quality_labels(odd_docs.sparkSession)).count() == report.where("predicted = 1").count()


OPERATORS = {
    "jaccard": lambda d: jaccard_join.jaccard_groups(d), "merkle": merkle.manifest, "tokens": lambda d: bpe.token_report(d),
    "quality": lambda d: quality_crf.quality_report(d, quality_labels(d.sparkSession)),
    "near": lambda d: minhash_dedup.near_duplicates(d), "near_kept": lambda d: minhash_dedup.one_of_each(d), "substring": debruijn.removal_report,
    "repetition": repetition.repetition_rules, "pii": pii.personal_data, "fingerprint": fingerprints.fingerprint_report, "lines": line_templates.template_report,
    "lines_kept": line_templates.drop_templates, "mix": mixing.mix_report, "mixed": mixing.mix_documents, "shards": sharding.shard_documents,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(no_docs, name):
    assert OPERATORS[name](no_docs).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("near_kept", "mixed")])
def test_one_result_for_every_row_with_repeats_and_missing_ids(odd_docs, name):
    assert OPERATORS[name](odd_docs).count() == odd_docs.count()

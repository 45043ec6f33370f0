"""Each operator against a plain version that reads its contract word for word."""

import hashlib
import re
from collections import Counter, defaultdict

from quernlex.llm.exact import exact_dedup, kept_documents
from quernlex.llm.licenses import PHRASES, scan_licenses
from quernlex.llm.mixing import mix
from quernlex.llm.tokens import token_counts
from quernlex.llm.wumanber import contamination, without_contaminated

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s or "")


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    want = sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), sha(t or "")) for i, t, *_ in rows)
    assert sorted(tuple(r) for r in exact_dedup(docs, stays="largest").collect()) == want
    small = {r["doc_id"] for r in exact_dedup(docs).collect() if r["kept"]}
    assert small == {min(g) for g in groups.values()}
    kept = kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == small
    by_id = {r[0]: tuple(r) for r in rows}
    assert all(tuple(r) == by_id[r["doc_id"]] for r in kept.collect())


def test_exact_dedup_odd(odd, empty):
    got = exact_dedup(odd, stays="largest").collect()
    assert Counter((r["doc_id"], r["kept"]) for r in got) == Counter([(None, False), (None, False), (5, True), (5, False), (5, True), (6, False), (7, True)])
    assert sorted((r["doc_id"], r["text"]) for r in kept_documents(odd).collect()) == [(5, "a b c"), (5, "d"), (6, None)]
    assert exact_dedup(empty).count() == 0 and kept_documents(empty).count() == 0


def test_token_counts(docs, rows, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in rows}
    got = token_counts(docs, limit=100).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert {r["doc_id"]: r["n_bytes"] for r in got} == {i: len((x or "").encode()) for i, x, *_ in rows}
    assert token_counts(odd).count() == 7 and token_counts(empty).count() == 0


def test_token_counts_of_odd_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["he said “don’t” — and left… at 5€", "naïve café\u0301 ﬁne", "x\u00a0y\u2003z \u3000w", "a\x0bb\x0cc\rd", "ΑΣ ΣΑΣ ẞ", "<|endoftext|>"*3 + " <|ENDOFTEXT|> <| endoftext|>", "e\n\u0301 x\u200b y", "z" * 5000, "<|endoftext|> a<|startoftext|>", "it's DON'T we'll ''s", "日本語 ١٢ Ǆ İ", "é   x", "a<|b", "½²³ ª º", "😀 ok", "\x1c\x1f\x85 b"]
    got = token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_mix(docs, rows, odd, empty):
    got = {r["doc_id"]: r for r in mix(docs, block_tokens=4).collect()}
    size = {i: len(SPACED.findall(t or "")) for i, t, *_ in rows}
    per = defaultdict(int)
    for i, _, _, s, *_ in rows:
        per[s] += size[i]
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, free, left = {}, set(names), 1.5 * sum(per.values())
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * per[s]]:
        for s in over:
            goal[s] = 2.0 * per[s]
        left -= sum(goal[s] for s in over)
        free -= set(over)
    goal |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = defaultdict(int)
    for i, _, _, s, *_ in rows:
        r = got[i]
        assert r["size"] == size[i] and r["source_size"] == per[s] and abs(r["target"] - goal[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * size[i]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 12 for s in names)
    assert sorted(map(str, mix(docs, block_tokens=4).collect())) == sorted(map(str, got.values()))
    assert mix(odd).count() == 7 and mix(empty).count() == 0


def test_mix_of_rows_without_ids(spark):
    """Thousands of rows without an id, most of them alike, are dealt over many shards."""
    rows = [(None, "a b c d e", "s")] * 3000 + [(None, None, "s")] * 2000 + [(k, f"x{k} y", "t") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mix(docs, shard_tokens=400).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    for source in (15_000, 1000):
        mine = [r for r in got if r["source_size"] == source]
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine) and mine[0]["target"] == (22_000.0 if source == 15_000 else 2000.0)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) < 0.01 * mine[0]["target"] + 50
    again = mix(docs.repartition(7), shard_tokens=400).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_by_racks(spark, docs, monkeypatch):
    from quernlex.llm import mixing

    monkeypatch.setattr(mixing, "RACK", 3)
    got = mix(docs, block_tokens=4, shard_tokens=100).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for target in {r["target"] for r in got}:
        mine = [r for r in got if r["target"] == target]
        assert abs(sum(r["taken"] for r in mine) - target) < 0.06 * target + 12


def test_exact_dedup_deals_out_copies(spark):
    """Many copies, most without an id or with one id; one row stays."""
    rows = [(None, "")] * 3000 + [(7, "")] * 50 + [(k, "t") for k in range(2000)] + [(1999, "t")] * 3 + [(None, "u")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = exact_dedup(docs, stays="largest").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    kept = sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["kept"]), key=str)
    assert kept == sorted([(7, 7, 3050), (1999, 1999, 2003), (None, None, 5)], key=str)
    assert sorted((r["doc_id"] for r in exact_dedup(docs).collect() if r["kept"]), key=str) == sorted([7, 0, None], key=str)


def test_apportion_is_sainte_lague(spark):
    import random

    from pyspark.sql import functions as F

    from quernlex.llm.mixing import apportion

    rng = random.Random(3)
    cases = [(g, p, rng.choice([0, rng.randrange(1, 2000), 100]), rng.randrange(0, 60)) for g in range(30) for p in range(rng.randrange(1, 9))]
    seats = {g: s for g, _, _, s in cases}
    frame = spark.createDataFrame([(g, p, v, seats[g]) for g, p, v, _ in cases], "g int, p int, v long, s long")
    got = {(r["g"], r["p"]): r["quota"] for r in apportion(frame, ["g"], "s", "v", [F.col("p")]).collect()}
    for g in seats:
        votes = {p: v for x, p, v, _ in cases if x == g}
        won = dict.fromkeys(votes, 0)
        for _ in range(seats[g] if sum(votes.values()) else 0):
            best = max((p for p in votes if votes[p]), key=lambda p: (votes[p] / (2 * won[p] + 1), -p))
            won[best] += 1
        assert {p: got[g, p] for p in votes} == won


def plain_contamination(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = PLAIN.findall(lower(t))
        m = min(8, len(w))
        for s in range(len(w) - m + 1) if m else ():
            windows[tuple(w[s : s + m])].add(str(i))
    out = {}
    for i, t, *_ in rows:
        w, hit, ids = PLAIN.findall(lower(t)), set(), set()
        for m in range(1, 9):
            for s in range(len(w) - m + 1):
                if (owners := windows.get(tuple(w[s : s + m]))) is not None:
                    hit.update(range(s, s + m))
                    ids |= owners
        out[i] = (len(w), len(hit), len(ids), sha(",".join(sorted(ids))), len(ids) >= 2)
    return out


def items_of(rows):
    long = [t for _, t, *_ in rows if t and 20 < len(t.split()) < 100]
    return [(k, " ".join(t.split()[3 : 3 + n])) for k, (t, n) in enumerate(zip(long, [8, 9, 20, 7, 12, 3, 40, 15, 2, 30], strict=False))] + [(50, ""), (51, None), (52, "zzz not there at all my friend of old"), (7, "one more text for an item that has one")]


def test_contamination(spark, docs, rows, odd, empty):
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_contamination(rows, items)
    for part_bytes in (1 << 20, 100):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in contamination(docs, bench, part_bytes=part_bytes).collect()}
        assert got == want
    assert any(v[4] for v in want.values())
    kept = without_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in want.items() if not v[4]}
    assert contamination(odd, bench).count() == 7 and contamination(empty, bench).count() == 0
    assert contamination(odd, bench.where("false")).where("n_items > 0").count() == 0


def test_contamination_by_a_large_benchmark(spark, tmp_path):
    """50 MB of benchmark, searched for in parts, against every window of it."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    import random

    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    items = []
    while sum(len(t) for _, t in items[-1:]) + len(items) * 50_000 < 50_000_000:
        items.append((f"i{len(items)}", " ".join(rng.choices(vocabulary, k=9200))[:50_000]))
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), tmp_path / "benchmark.parquet")
    texts = []
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(1, 200))
        for _ in range(k % 4):
            _, t = rng.choice(items)
            at, n = rng.randrange(9000), rng.randrange(6, 30)
            words += t.split()[at : at + n] + rng.choices(vocabulary, k=5)
        texts.append((k, " ".join(words)))
    texts += [(100, None), (101, "")]
    # the windows of the documents, looked up while the benchmark goes by
    at = defaultdict(list)
    for k, t in texts:
        w = PLAIN.findall(t or "")
        for s in range(len(w) - 7):
            at[tuple(w[s : s + 8])].append((k, s))
    firsts = {w[:3] for w in at}
    hit, ids = defaultdict(set), defaultdict(set)
    for i, t in items:
        w = t.split()
        for s in range(len(w) - 7):
            if (w[s], w[s + 1], w[s + 2]) in firsts:
                for k, p in at.get(tuple(w[s : s + 8]), ()):
                    hit[k].update(range(p, p + 8))
                    ids[k].add(i)
    bench = spark.read.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in contamination(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert got == {k: (len(hit[k]), len(ids[k]), sha(",".join(sorted(ids[k])))) for k, _ in texts}
    assert sum(map(bool, ids.values())) > 30


def test_contamination_odd_tables(spark):
    rows = [("a", "the quick brown fox jumps over it all today", 1, "x"), (None, None, None, None), ("a", "", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_items int, hits string")
    items = [(1, "quick brown fox jumps over it all today"), (1, "quick brown fox jumps over it all today"), (None, "the quick brown fox jumps over it all"), (2, None), (3, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part_bytes in (1 << 20, 20):
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in contamination(docs, bench, part_bytes=part_bytes).collect()), key=str)
        assert got == sorted([("a", 9, 9, 2), (None, 0, 0, 0), ("a", 0, 0, 0)], key=str)
        kept = without_contaminated(docs, bench, part_bytes=part_bytes)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, rows[1:]), key=str)


def test_license_base(spark, odd, empty):
    texts = [
        "Released under the MIT License.", "under the mit license, UNDER-THE-MIT-LICENSE", "Apache License, Version 2.0", "apache license version 20",
        "CC BY-NC 4.0", "cc by ncc", "Licensed under CC BY-NC 4.0.", None, "", "éunder the mit license", "mit license under the", "x " * 500 + "\nThis work is licensed under the GNU General Public License, version 3.",
        "Under the K mit license", "under the mİt license",
    ]
    got = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        w = PLAIN.findall(lower(texts[r["doc_id"]]))
        at = {p: [s for s in range(len(w)) if w[s : s + len(p.split())] == p.split()] for p in PHRASES}
        flat = sorted(s for v in at.values() for s in v)
        base = sorted({PHRASES[p] for p, v in at.items() if v})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(flat), min(flat, default=None), max(flat, default=None), ",".join(base)), r
        assert set(base) <= set(r["labels"].split(",")) or not base
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[0] == "mit" and labels[6] == "cc-by-nc" and labels[11] == "gpl-3" and labels[10] == "mit" or labels[10] == ""
    assert scan_licenses(odd).count() == 7 and scan_licenses(empty).count() == 0


def test_license_join_is_exact(spark):
    import random

    from quernlex.llm.licenses import TEMPLATES

    rng = random.Random(5)
    vocabulary = sorted({t for x in TEMPLATES for t in x.text.split()}) + ["other", "words"]
    texts = []
    for _ in range(200):
        w = [t if rng.random() > 0.05 else rng.choice(vocabulary) for t in rng.choice(TEMPLATES).text.split()]
        texts.append(" ".join([rng.choice(["other", "words", "the"]) for _ in range(rng.randrange(40))] + w + ["words"] * rng.randrange(30)))
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = 0
    for i, text in enumerate(texts):
        w, want = text.split(), []
        for t in TEMPLATES:
            tokens, n = set(t.text.split()), len(t.text.split())
            for b in range(0, len(w), n):
                block = w[b : b + 3 * n]
                share = len(tokens & set(block)) / len(tokens)
                if share >= 0.8 - 1e-9 and any(f" {x} " in f" {' '.join(block)} " for x in t.names):
                    want.append((t.label, b, round(share, 9)))
        found += len(want)
        assert sorted((x["label"], x["start"], round(x["share"], 9)) for x in got[i]["blocks"]) == sorted(want), text
        labels = {x[0] for x in want} | set(filter(None, got[i]["base_labels"].split(",")))
        assert got[i]["labels"] == ",".join(sorted(labels))
        assert abs(got[i]["score"] - (1.0 if got[i]["n_base"] else max((x[2] for x in want), default=0))) < 1e-6
    assert found > 200


def test_license_near_misses(spark):
    want = {
        "Licensed under CC BY 4.0": "cc-by",
        "This text is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
        "Released under the Apache License": "",
        "the film was released under the commercial license": "",
        "GNU GPL version 2": "gpl-2",
        "GPL version 3": "gpl-3",
        "Apache License Version 1.0": "",
        "a license is released under the terms of the committee, version 2": "",
        "Released under the MIT License": "mit",
        "word " * 50 + "Licensed under the Apache License, Version 2.0 (the License)" + " word" * 50: "apache-2",
        "subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2",
        "subject to the terms of the Mozilla Public License, v. 1.1": "",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "you can redistribute it under the terms of the GNU Lesser General Public License version 3": "",
    }
    rows = [(i, t, "mine", 1.5) for i, t in enumerate(want)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")).collect()
    assert {t: r["labels"] for t, r in zip(want, sorted(got, key=lambda r: r["doc_id"]), strict=True)} == want


def test_license_pairs_need_no_name(spark):
    """Every pair that meets the threshold is returned, whether or not the block names the license."""
    import random

    from quernlex.llm.licenses import TEMPLATES, Template

    rng = random.Random(9)
    vocabulary = sorted({t for x in TEMPLATES for t in x.text.split()}) + ["other"]
    templates, texts = [*TEMPLATES, Template("mine", "Free for ANY use, at one's own risk", ()), Template("loud", "SHARE-AND-ENJOY", ("Enjoy",)), Template("none", "", ())], ["share and", "share and enjoy; free for any use at one S risk", None, ""]
    for _ in range(40):
        for t in rng.sample(TEMPLATES, 2):
            texts.append(" ".join([w if rng.random() > 0.12 else rng.choice(vocabulary) for w in t.text.split()] + ["the"] * rng.randrange(60)))
        texts[-1] += " " + texts[-2]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=templates).collect()}
    unnamed = 0
    for i, text in enumerate(texts):
        w, want = PLAIN.findall(lower(text or "")), []
        for t in templates:
            words = PLAIN.findall(lower(t.text))
            for b in range(0, len(w), len(words)) if words else ():
                block = w[b : b + 3 * len(words)]
                share = len(set(words) & set(block)) / len(set(words))
                if share >= 0.8 - 1e-9:
                    want.append((t.label, b, round(share, 9), not t.names or any(f" {lower(x)} " in f" {' '.join(block)} " for x in t.names)))
        unnamed += sum(not x[3] for x in want)
        assert sorted((x["label"], x["start"], round(x["share"], 9), x["named"]) for x in got[i]["pairs"]) == sorted(want), text
        assert sorted((x["label"], x["start"], round(x["share"], 9)) for x in got[i]["blocks"]) == sorted(x[:3] for x in want if x[3])
    assert unnamed > 100 and got[0]["labels"] == "" and got[1]["labels"] == "loud,mine"

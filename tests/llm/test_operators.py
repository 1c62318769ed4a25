"""Each operator against a brute-force version, a library or a round trip on small rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, graph, langid, merkle, queries, simhash, substring, tokenfile, toxicity, urlfilter, warc

TEXTS = ["", "a", "the cat sat on the mat. " * 3, "Ünï ß 中文 😀  two\n\nlines\r\n", "x" * 50 + " 12.5 it's I'LL don't", "\t 　 \x85 end ", "é. É, naïve"]


def _words(seed, n, vocabulary):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# byte-level BPE


def test_bpe_is_tiktoken():
    import public_tokenizers
    import tiktoken

    path = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Codec(bpe.read_ranks(path), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(5)
    signs = " \n\t.,ab'sré中　\x85😀19  \r\x1c"
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["ab" * 3000, "the quick brown fox " * 500]
    for t in texts:
        ids = own.encode(t)
        assert ids == other.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_bpe_small_tables_and_long_pieces_give_the_same():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    own = bpe.Codec(ranks, public_tokenizers.PATTERN)
    own.transducer = bpe.Transducer(own.transducer.graph, max_cells=5000)
    own.transducer.PORTION = 16
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    pieces = ["".join(rng.choice("aeinorst") for _ in range(rng.choice([3, 8, 15, 16, 17, 33, 700]))) for _ in range(400)]
    pieces += ["".join(rng.choice("中文字符é ß😀") for _ in range(rng.randrange(1, 300))) for _ in range(100)] + ["a" * 5000, "-" * 3000, " " * 4000, "ab" * 2000]
    texts = [" ".join(rng.sample(pieces, 5)) for _ in range(60)] + pieces
    for k in range(0, len(texts), 40):
        ids, lengths = own.encode_all([*texts[k : k + 40], None, ""])
        assert ids.tolist() == [i for t in texts[k : k + 40] for i in other.encode_ordinary(t)]
        assert lengths.tolist()[-2:] == [0, 0] and len(own.transducer.states) * own.transducer.width < 200_000


def test_bpe_pairs_keep_apart_as_merging_says():
    graph_ = bpe.TokenGraph(bpe.read_ranks(queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")))

    def merged(raw):
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            ranks = [(graph_.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in graph_.ranks]
            if not ranks:
                return parts
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(1)
    for _ in range(3000):
        a, b = (rng.randrange(len(graph_.ranks)) for _ in "ab")
        assert graph_.adjacent(a, b) == (merged(graph_.bytes_of[a] + graph_.bytes_of[b]) == [graph_.bytes_of[a], graph_.bytes_of[b]])


def test_bpe_stream_decoder_takes_any_portions():
    own = bpe.codec(queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), r"(?s).+")
    text = "naïve 中文 😀 end"
    ids = [own.transducer.graph.ranks[bytes([b])] for b in text.encode()]
    stream = bpe.StreamDecoder(own.bytes_of)
    assert "".join(stream.feed([i]) for i in ids) + stream.feed((), True) == text


def test_bpe_frames_go_round(spark):
    import public_tokenizers

    path = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "doc_id long, text string")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in bpe.decode(encoded, path).collect()} == dict(enumerate(TEXTS)) | {99: ""}


# decontamination


def test_decontamination_by_brute_force(spark):
    items = [(k, " ".join(_words(k, n, 6))) for k, n in enumerate([3, 9, 10, 11, 14, 25, 0])] + [(50, None), (51, "W1, w2!")]
    docs = [(k, " ".join(_words(100 + k, 60, 6))) for k in range(30)] + [(90, "W1 w2"), (91, None)]
    found = {r.doc_id: r for r in decontam.annotate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), keep=("text",)).collect()}
    for doc_id, text in docs:
        words, hit, ids = decontam.words((text or "").encode()), set(), set()
        for item, source in items:
            for w in decontam.item_windows((source or "").encode(), 10):
                for i in range(len(words) - len(w) + 1):
                    if words[i : i + len(w)] == w:
                        hit |= set(range(i, i + len(w)))
                        ids.add(item)
        r = found[doc_id]
        assert (r.n_words, r.n_hit, r["items"]) == (len(words), len(hit), sorted(ids))
        covered = [w for s in r.spans for w in decontam.words(text.encode()[s.start : s.stop])]
        assert covered == [words[i] for i in sorted(hit)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_decontamination_in_shards_gives_the_same(spark, kind):
    rng = random.Random(14)
    items = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([2, 9, 12, 30])))) for k in range(40)]
    docs = [(k, " ".join([*(f"w{rng.randrange(60)}" for _ in range(40)), rng.choice(items)[1], "end", rng.choice(items)[1]])) for k in range(50)] + [(7, None), (7, "w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string").select(F.concat(F.lit("" if kind == "long" else "item "), "item_id").cast(kind).alias("item_id"), "text")
    one, many = decontam.annotate(d, i), decontam.annotate(d, i, shard_bytes=300)
    assert dict(many.dtypes)["items"] == f"array<{'bigint' if kind == 'long' else kind}>"
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert one.where("size(items) > 1").count() > 30


# SimHash


def test_fingerprint_by_definition():
    for t in [*TEXTS, " ".join(_words(1, 500, 300))]:
        words = t.encode().translate(simhash._LOWER).split()
        shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        assert simhash.fingerprint(t.encode()) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _linked(values, limit=4):
    parent = list(range(len(values)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(values):
        for j in range(i):
            if bin((a ^ values[j]) & (1 << 64) - 1).count("1") <= limit:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(values))]


@pytest.mark.parametrize("bucket_limit", [20_000, 3, 60])
def test_links_and_components_by_brute_force(spark, bucket_limit):
    rng = random.Random(2)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        v = rng.choice(values)
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            v ^= 1 << b
        values.append(v)
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(fp, k) for k, fp in enumerate(signed)], "fp long, node long")
    found = simhash.links(nodes, bucket_limit=bucket_limit)
    name = {fp: k for k, fp in enumerate(signed)}
    edges = [(name[r.x], name[r.y]) for r in found.collect()]
    assert all(bin(values[a] ^ values[b]).count("1") <= 4 for a, b in edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _linked(values)
    assert [got.get(k, k) for k in range(len(values))] == want


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(0, 40)]
    star = [(1000 - k, 1000) for k in range(1, 30)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[1000 - k] for k in range(30)} == {971}


def test_plan_keeps_every_linked_pair():
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for rows in (100, 10**6, 10**9):
        parts = simhash.plan(sample, rows)
        for _ in range(300):
            flips = rng.choice(64, 4, replace=False)
            assert any(sum(int(f) in bits for f in flips) <= t for bits, t in parts)


# substring dedup


def test_substring_dedup_by_brute_force(spark):
    rng = random.Random(4)
    base = [[f"v{rng.randrange(400)}" for _ in range(rng.choice([5, 13, 14, 60]))] for _ in range(8)]
    docs = []
    for k in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            b = rng.choice(base)
            at = rng.randrange(len(b))
            words += b[at : at + rng.randrange(1, 60)] + [f"v{rng.randrange(400)}"]
        docs.append((rng.randrange(50), "\n ".join(words) if k % 5 else None))
    first = {}
    for doc_id, t in docs:
        w = (t or "").split()
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(doc_id, first.get(tuple(w[k : k + 13]), doc_id))
    want = []
    for doc_id, t in docs:
        w = (t or "").split()
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < doc_id for j in range(k, k + 13)}
        want.append((doc_id, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    rows = substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == sorted(want)
    assert sum(r.n_removed for r in rows) > 0


def test_difference_cover_aligns_all_offsets():
    for i in range(7):
        for j in range(7):
            assert any((i + d) % 7 in substring.COVER and (j + d) % 7 in substring.COVER for d in range(7))


# token files


def _texts_with_added_tokens():
    rng = random.Random(3)
    signs = [*" \n\t.,aAbsTJI'é中　\x85😀19  \r\x1c\u030c\u0308\u0307ßÉİ", "<|endoftext|>", "it's", "word.", "E.T.", " .", "'s."]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["hello <|endoftext|> world", "<|ENDOFTEXT|> a", "<|startoftext|>x."]


def test_token_files(spark, tmp_path, data):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    more = [(10**6 + k, t) for k, t in enumerate(TEXTS + [None] + _texts_with_added_tokens())] + [(5, "one"), (5, "two words"), (5, "one"), (7, None)]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    out = str(tmp_path / "tokens")
    tokenfile.write(docs, path, out, files=5)
    plain = Tokenizer.from_file(path)
    want = sorted((r.doc_id, [*plain.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect())
    written = tokenfile.read(spark, out).collect()
    assert sorted((r.doc_id, r.tokens) for r in written) == want
    # a repeated doc_id's rows have the places that the files give them
    start, places = 0, []
    for r in sorted(written, key=lambda r: (r.part, r["at"])):
        places.append((r.doc_id, start, len(r.tokens), zlib.crc32(np.array(r.tokens, "<u4").tobytes())))
        start += len(r.tokens)
    assert [p[0] for p in places] == sorted(p[0] for p in places)
    assert sorted(map(tuple, tokenfile.offsets(tokenfile.read(spark, out)).collect())) == sorted(places)


@pytest.mark.parametrize("limit", [10, 10**6])
def test_token_table_size_does_not_matter(limit):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    own, plain = tokenfile.TextEncoder(path, max_words=limit), Tokenizer.from_file(path)
    assert own.wordwise
    for wordwise in (True, False):
        own.wordwise = wordwise
        texts = _texts_with_added_tokens()[-400:]
        for k in range(0, len(texts), 50):
            ids, lengths = own.encode_all(pa.array(texts[k : k + 50]))
            each = [plain.encode(t, add_special_tokens=False).ids for t in texts[k : k + 50]]
            assert ids.tolist() == [i for x in each for i in x] and lengths.tolist() == list(map(len, each))


def test_token_files_skip_row_groups(spark, tmp_path):
    """A filter on doc_id reads one row group of the file, not all."""
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    out = str(tmp_path / "tokens")
    tokenfile.write(docs, queries.tokenizer_path("word_bpe_49k.json"), out, files=1, stride=1000)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = tokenfile.read(spark, out).where("doc_id = 12345")
        assert "EqualTo(doc_id,12345)" in one._jdf.queryExecution().executedPlan().toString()
        assert one.count() == 1
        one.collect()
        plan = one._jdf.queryExecution().executedPlan()
        assert 1 <= plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value() <= 5000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


# toxicity


def test_grammar_modifiers_and_evidence():
    model = {"evidence": {"idiot": [4.0, 5.0, 6.0], "vequ*": [0.0, 3.0, 6.0]}, "prior": -2.0, "weights": {"threat": 1.0, "target": 0.5, "negation": -2.0, "report": -1.0}}
    g = toxicity.Grammar(model)
    score = lambda t: g.score(t)[0]
    assert score("") == score("a fine day") < 0.05
    assert score("what an idiot") > 0.7 > score("vequxa here")
    assert score("vequxa and vequbo here") > 0.7
    assert score("not an idiot at all") < score("an idiot at all") < score("you idiot")
    assert score('she said "idiot" then') < score("idiot then")
    assert score("idiotic vequ") == score("nothing")
    assert list(g.clauses("ok. Not an IDIOT; fine"))[0][1] == [("idiot", ["negation"])]


def test_grammar_reads_as_all_its_paths_say():
    """The best accepted path, against every path of the parts' arcs and against the marks by definition."""
    rng = random.Random(16)
    weights = {"threat": 0.7, "target": -0.4, "negation": -1.5, "report": 0.3}
    g = toxicity.Grammar({"evidence": {}, "prior": 0.0, "weights": weights})

    def paths(t, symbols):
        found = [(t.start, ())]
        for s in symbols:
            found = [(to, (*marks, mark)) for state, marks in found for to, mark in t.arcs[state, s]]
        return [marks for state, marks in found if state in t.final]

    def defined(symbols):
        out, words, reported = [], [s for s in symbols if s[0] != "q"], False
        for k, s in enumerate(words):
            reported_by_quote = any(x[0] == "q" for x in symbols[: [i for i, y in enumerate(symbols) if y[0] != "q"][k]])
            near = lambda c, a, b, k=k: any(x[0] == c for x in words[max(0, k - a) : k] + words[k + 1 : k + 1 + b])
            if s[1:]:
                out.append({m for m, is_so in (("threat", near("u", 3, 0)), ("target", near("t", 4, 4)), ("negation", near("n", 3, 0)), ("report", reported or reported_by_quote)) if is_so})
            reported |= s[0] == "r"
        return out

    for _ in range(1500):
        symbols = [c if c == "q" else c + rng.choice(["", "", "!"]) for c in (rng.choice("ntuoooooqr") for _ in range(rng.randrange(1, 10)))]
        each = [paths(t, symbols) for t in toxicity.TRANSDUCERS]
        assert all(len(p) == 1 for p in each)
        weight, marks = g.read(symbols)
        assert [set(m) for m in marks] == defined(symbols)
        assert weight == pytest.approx(sum(weights[m] for p in each for m in p[0] if m))


def test_toxicity_training_rows_do_not_depend_on_their_order(spark):
    rows = [(k, f"one two three four five {'abcdef'[k % 6]}", 1) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = [sorted(map(tuple, toxicity.training_rows(x, x.select("doc_id", "toxic"), 1000, 1).collect())) for x in (d, d.orderBy(F.desc("doc_id")).repartition(5))]
    assert found[0] == found[1]


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(6)
    clean = lambda: [f"c{rng.randrange(3000)}lm" for _ in range(60)]
    docs, labels = [], []
    for k in range(900):
        w = clean()
        if k % 6 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["zonk", f"brav{rng.choice('aeiou')}{rng.choice('xyz')}lo"])
        docs.append((k, " ".join(w)))
        labels.append((k, int(k % 6 == 0)))
    docs += [(1000 + k, docs[0][1] + f" x{k}") for k in range(80)]  # copies of a toxic text do not make its words toxic
    labels += [(1000 + k, 1) for k in range(80)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y.where("doc_id % 3 <> 1"))
    assert set(model["evidence"]) <= {"zonk", "brav*", "bra*", "zon*"} and len(model["evidence"]) == 2
    got = {r.doc_id: r.predicted for r in toxicity.score(d, model).collect()}
    held = [(k, v) for k, v in labels if k % 3 == 1 and k < 900]
    assert np.mean([got[k] == v for k, v in held]) > 0.97


# language id


def test_language_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs, ~queries.held_out())
    out = langid.predict(docs, model, keep=("lang",)).where(queries.held_out()).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_scores_by_brute_force(spark):
    """Naive Bayes over the same buckets of character n-grams, counted in plain Python."""
    import math
    from collections import Counter

    def buckets(text):
        folded = "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in "\n" + text + "\n\n\n\n")
        out, run = [], ""
        for c in folded:
            run += "" if c == " " and run.endswith(" ") else c
        for k in range(len(run) - 3):
            rolled = 0
            for size, multiplier in langid._SIZES:
                rolled = ((rolled ^ (rolled >> 13)) * 0x01000193 + ord(run[k + size - 1])) & 0xFFFFFFFF
                mixed = (rolled * multiplier & 0xFFFFFFFF) ^ (rolled >> 15)
                out.append((mixed * 2654435761 & 0xFFFFFFFF) >> (32 - langid.BITS))
        return out

    rng = random.Random(17)
    letters = {"xx": "abcde  é1", "yy": "cdefgh ü.", "zz": "中文字符 abc"}
    rows = [(k, "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(0, 80))), lang) for k in range(150) for lang in [rng.choice(list(letters))]]
    rows += [(500, None, "xx"), (501, "12 ..", "yy"), (502, "Ab", None), (503, "中" * 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs, F.lit(True))).collect()}
    counts = {}
    for _, t, lang in rows:
        if lang and t is not None:
            counts.setdefault(lang, Counter()).update(buckets(t))
    size = 1 << langid.BITS
    for doc_id, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
            continue
        odds = {lang: sum(math.log((c[b] + 0.5) / (c.total() + 0.5 * size)) for b in buckets(t)) for lang, c in counts.items()}
        best = max(sorted(odds), key=odds.get)
        assert got[doc_id].score == pytest.approx(1 / sum(math.exp(x - odds[best]) for x in odds.values()), abs=1e-3)
        assert got[doc_id].lang_pred == best


# URL filters


@pytest.mark.parametrize("n_rules", [0, 1, 60, 400])
def test_url_filter_by_brute_force(spark, n_rules):
    rng = random.Random(7)
    label = lambda: rng.choice(["a", "b", "org", "com", "example", "ab", "org,example", "a)b", "", "é"])
    name = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    way = lambda: "/" + "/".join(rng.choice(["en", "es", "1", "12"]) for _ in range(rng.randrange(3)))
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    urls = [(k, f"http://{name().upper().replace('É', 'é')}{way()}{rng.choice(['', '?q', '#f', ''])}") for k in range(600)] + [(900, None), (901, "x"), (902, "http://org"), (902, "http://org"), (903, "http://org,example/x")]
    rules = sorted({(rng.choice([name(), ""]), rng.choice([way(), ""]), "block" if rng.random() < 0.5 else "allow") for _ in range(n_rules)}) + [("a/b", "", "block"), (None, "/", "block")] * (n_rules > 1)
    got = urlfilter.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules + rules[:3], "host string, path string, verdict string")).collect()
    assert sorted(r.page_id for r in got) == sorted(k for k, _ in urls)
    of = dict(urls)
    for r in got:
        rest = (of[r.page_id] or "").partition("://")[2]
        end = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = rest[:end].translate(fold), rest[end:].split("?")[0].split("#")[0]
        fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h is not None and "/" not in h and (h in ("", host) or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == (max(fits)[3:] if fits else (None, "allow"))


# WARC


def test_warc_index_and_records(spark):
    rows = [(k, f"http://{'abc'[k % 3]}.example.com/{k % 11}", "same" if k % 5 == 0 else f"<p>{k}é</p>") for k in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write(pages, block_rows=7)
    some = pages.where("page_id in (3, 10)")
    near = {r.page_id for r in warc.look_up(archive, some).collect()}
    assert near == {k for k, u, _ in rows if u in {rows[3][1], rows[10][1]}}
    got = {r.page_id: r for r in warc.read(archive, warc.look_up(archive, pages)).collect()}
    assert len(got) == 80
    for k, url, html in rows:
        r = got[k]
        assert r.url == url and r.payload_bytes == len(html.encode())
        assert (r.record_type, r.refers_to) == (("revisit", 75) if html == "same" and k != 75 else ("response", None))
    assert warc.look_up(archive, spark.createDataFrame([("http://none.org/",)], "url string")).count() == 0


def test_warc_repeated_pages_by_brute_force(spark):
    rng = random.Random(15)
    address = lambda: rng.choice([None, "", "a/)", "http://)a", "http://org,example/x", "http://org/x", "x", "http://a.b/"])
    rows = [(5, "u", "X"), (5, "u", "Y"), (9, "v", "Y"), (9, "v", "Y")] + [(rng.randrange(12, 40), address(), rng.choice([None, "", "p", "q", "r" * 50, f"own {k}"])) for k in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write(pages, block_rows=5)
    last = {}
    for page, _, html in rows:
        last[html or ""] = max(page, last.get(html or "", page))
    want = list((page, len((html or "").encode()), "response" if last[html or ""] == page else "revisit", None if last[html or ""] == page else last[html or ""], url) for page, url, html in rows)
    got = warc.read(archive, warc.look_up(archive, pages)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.url) for r in got), key=str) == sorted(want, key=str)
    for url in ("http://)a", "a/)", "http://org,example/x", None):
        found = warc.look_up(archive, spark.createDataFrame([(url,)], "url string")).collect()
        assert sorted(r.page_id for r in found) == sorted(p for p, u, _ in rows if u == url)


def test_warc_keeps_small_payloads_apart(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    archive = warc.write(pages, min_revisit=3)
    assert [r.record_type for r in warc.read(archive, warc.look_up(archive, pages)).collect()] == ["response"] * 2


# Merkle fingerprints


def test_merkle_locates_edits(spark):
    base = "".join(f"line {k} has words\n" for k in range(40))
    pairs = [(base, base.replace("line 17", "LINE 17") + "tail"), (base, base), ("", ""), ("a\nb\nc", "a\nb\nd"), ("x", "x ")]
    a, b = merkle.tree(F.col("a")), merkle.tree(F.col("b"))
    rows = spark.createDataFrame(pairs, "a string, b string").select(merkle.differing(a, b).alias("d"), (merkle.root(a) == merkle.root(b)).alias("same"), (merkle.to_string(a) == merkle.to_string(b)).alias("text")).collect()
    assert [r.d for r in rows] == [[17, 40], [], [], [2], [0]]
    assert [r.same for r in rows] == [p[0] == p[1] for p in pairs] == [r.text for r in rows]


def test_merkle_next_document_by_brute_force(spark):
    rng = random.Random(8)
    ids = rng.sample(range(-500, 5000), 120)
    docs = [(k, "é" * rng.randrange(0, 30) + f" doc {k} " * rng.randrange(1, 9)) for k in ids] + [(9999, None)]
    got = {r.doc_id: r for r in merkle.fingerprint_with_edit(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    ordered = sorted(docs)
    for k, (doc_id, t) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(t) // 4
        assert got[doc_id].edited == t[: len(t) - n] + following[:n] and got[doc_id].n_chars == len(t)


def test_merkle_fingerprint_and_likeness_by_brute_force(spark):
    """Leaves cut by plain Python, digests by xxhash and hashlib as Spark's functions define them."""
    import re
    import struct

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    leaf = lambda x: xxhash.xxh64_intdigest(x.encode(), 42)

    def over(longs):  # an array of longs: each one's hash seeds the next
        seed = 42
        for x in longs:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
        return seed

    def tree(text):
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        paragraphs = [[leaf("".join(run)) for run in _runs(line)] for line in lines]
        return [paragraphs[k : k + merkle.SECTION] for k in range(0, len(paragraphs), merkle.SECTION)]

    def _runs(line):
        pieces = re.findall(r"\s*\S+\s*", line, re.ASCII) or [line]
        words = re.findall(r"\S+\s*", line, re.ASCII)
        if not words:
            return [[line]]
        head = line[: len(line) - len(line.lstrip(" \t\n\r\x0b\x0c"))]
        words[0] = head + words[0]
        assert "".join(words) == line and len(words) == len(pieces)
        return [words[k : k + merkle.RUN] for k in range(0, len(words), merkle.RUN)]

    def string(nodes):
        sections = [hashlib.sha256(",".join(f"{over(p):X}" for p in s).encode()).hexdigest() for s in nodes]
        top = hashlib.sha256(",".join(sections).encode()).hexdigest()
        return top + ":" + "/".join(".".join("".join(f"{d:x}"[-8:] for d in p) for p in s) for s in nodes)

    def like(a, b):
        x, y = ({d for s in n for p in s for d in p} for n in (a, b))
        return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0

    rng = random.Random(18)
    vocabulary = [f"w{k}" for k in range(30)] + ["é", "中文", "x."]
    make = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\n", " \n ", "\t"]) for _ in range(rng.randrange(0, 120)))
    docs = [(k, make()) for k in range(60)] + [(100, None), (101, ""), (102, " \n\n "), (103, "one")]
    found = merkle.fingerprint_with_edit(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: r for r in found.select("*", merkle.to_string(F.col("tree")).alias("fingerprint"), merkle.to_string(F.col("edited_tree")).alias("edited_fingerprint")).collect()}
    for k, (doc_id, t) in enumerate(docs):
        t, following, r = t or "", docs[(k + 1) % len(docs)][1] or "", got[doc_id]
        own, edited, other = tree(t), tree(r.edited), tree(following)
        assert [[[x & (1 << 64) - 1 for x in p] for p in s] for s in r.tree] == own
        assert (r.fingerprint, r.edited_fingerprint) == (string(own), string(edited))
        assert (r.near_edited, r.near_next) == (pytest.approx(like(own, edited)), pytest.approx(like(own, other)))


def test_simhash_query_by_brute_force(spark, data):
    """Whole documents: fingerprints by definition, all pairs compared, components by union."""
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    values = [simhash.fingerprint((r.text or "").encode()) for r in rows]
    order = sorted(range(len(rows)), key=lambda k: rows[k].doc_id)
    want = _linked([values[k] for k in order])
    got = {r.doc_id: r for r in queries.op8_simhash_near_dedup(spark, data).collect()}
    assert len(got) == len(rows)
    for place, k in enumerate(order):
        r = got[rows[k].doc_id]
        assert (r.fingerprint, r.component_id) == (f"{values[k]:016x}", rows[order[want[place]]].doc_id)


# the pipeline


def test_near_duplicate_stage_finds_every_copy_over_eight_tenths(spark):
    import corpus_pipeline

    rng = random.Random(12)
    prose = lambda n: [f"{rng.choice('bcdfg')}{rng.randrange(4000)}" for _ in range(n)]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    words = {1000 + k: prose(rng.randrange(60, 300)) for k in range(60)}
    for k in range(60):  # smaller ids that share less than 0.8: they are the hubs of their shingles
        base = words[1000 + k]
        words[k] = [*base[: len(base) // 2], *prose(len(base) // 2)]
    for k in range(2000, 2240):
        base = words[1000 + k % 60]
        words[k] = base[:]
        for at in rng.sample(range(len(base)), rng.randrange(1, max(2, len(base) // 40))):
            words[k][at] = "edited"
    words |= {5000: [], 5001: [], 5002: ["One"], 5003: ["one"], 5004: ["two"]}
    sets = {k: shingles([x.lower() for x in w]) for k, w in words.items()}
    ids, parent = sorted(words), {k: k for k in words}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    near = 0
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            like = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if like >= 0.8:
                near += like <= 0.95
                parent[max(find(a), find(b))] = min(find(a), find(b))
    rows = [(k, " ".join(w) or None, "en", "s", 0) for k, w in words.items()] + [(None, "x", "en", "s", 1), (1000, " ".join(words[1000]), "en", "s", 0)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert near > 200
    assert sorted(r.doc_id for r in kept) == sorted({find(k) for k in words})


def test_pipeline_takes_planted_cases_out(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    prose = lambda n: [f"{rng.choice('bcdfg')}{rng.randrange(4000)}" for _ in range(n)]
    docs = {k: prose(120) for k in range(400)}
    for k in range(0, 400, 8):
        for _ in range(4):
            docs[k][rng.randrange(120)] = "zonk"
    docs[1001] = docs[1][:]
    docs[1002] = [*docs[2][:60], "changed", *docs[2][61:]]
    docs[1003] = [*prose(80), *docs[3][20:90], *prose(80)]
    item = prose(40)
    docs[1004] = [*prose(50), *item, *prose(50)]
    rows = [(k, " ".join(w), "en", "s", len(" ".join(w))) for k, w in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 8 == 0)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {k for k in range(400) if k % 8}
    assert set(out) == clean | {1003}
    kept = [*docs[1003][:80], *docs[1003][150:]]
    assert out[1003].decoded_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert out[5].decoded_sha256 == hashlib.sha256(" ".join(docs[5]).encode()).hexdigest()


def test_insults_are_read_letter_by_letter():
    """Whole words first, then the shortest stem that the word goes on after."""
    rng = random.Random(12)
    letters = "abc"
    for _ in range(40):
        patterns = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) + rng.choice(["", "*"]) for _ in range(12)}
        machine = toxicity.Insults(patterns)
        for _ in range(300):
            word = "".join(rng.choice(letters + "d") for _ in range(rng.randrange(1, 8)))
            stems = sorted((p for p in patterns if p.endswith("*") and len(word) > len(p) - 1 and word.startswith(p[:-1])), key=len)
            assert machine.read(word) == (word if word in patterns else next(iter(stems), None))
    assert toxicity.Insults([]).read("word") is None

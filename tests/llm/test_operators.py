"""Each operator against a plain computation, on rows with nulls, repeats, ties, empty and long texts."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import pytest

WORDS = "the of and in alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows(as_doc):
    rng = random.Random(4)
    made = [as_doc(k, prose(rng, rng.randrange(5, 120)), rng.choice(["en", "de"])) for k in range(0, 120, 2)]
    base = prose(rng, 90)
    made += [as_doc(1, base), as_doc(3, base), as_doc(5, base + " tail"), as_doc(7, "x" + base[1:]), as_doc(9, None), as_doc(11, ""), as_doc(13, " \n "), as_doc(15, "one two"), as_doc(17, "One  TWO")]
    made += [as_doc(19, "é語🙂 " * 40), as_doc(21, "a" * 3000), as_doc(23, prose(rng, 4000)), as_doc(25, base[:250] + " " + prose(rng, 30) + " " + base[100:400])]
    made += [as_doc(27, "same"), as_doc(27, "same"), as_doc(None, "same"), as_doc(None, None)]
    return made


def collect(df):
    return [r.asDict() for r in df.collect()]


def test_fingerprints(table, rows):
    from widegrain.llm import fingerprints as op

    got = collect(op.fingerprint_documents(table(rows)))
    order = sorted(((d, t or "") for d, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    expect = []
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(t) // 4
        new = t[: len(t) - n] + after[:n]
        a, b, c = (op.chunks(x.encode()) for x in (t, new, after))
        expect.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), op.encode(a), op.encode(b), op.containment(a, b), op.containment(a, c)))
    key = lambda x: (x[0] is not None, x[0] or 0, *map(str, x[1:]))
    mine = [tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) for r in got]
    assert sorted(mine, key=key) == sorted(expect, key=key)


def plain_chunks(raw):
    """The chunks byte by byte: a rolling gear hash, and at each byte the rule for the size so far."""
    from widegrain.llm import fingerprints as op

    out, start, h = [], 0, 0
    for k, byte in enumerate(raw):
        h = (2 * h + int(op.GEAR[byte])) % 2**32
        size = k + 1 - start
        bits = op.STRICT_BITS if size < op.TARGET else op.LOOSE_BITS
        if size == op.MOST or size >= op.LEAST and h >> (32 - bits) == 0:
            out.append(raw[start : k + 1])
            start = k + 1
    return out + [raw[start:]] * (start < len(raw))


def test_chunks_against_bytes():
    from widegrain.llm import fingerprints as op

    rng = random.Random(31)
    texts = [b"", b"a", b"a" * 3000, prose(rng, 4000).encode(), bytes(rng.randrange(256) for _ in range(20_000)), "é語🙂 ".encode() * 500, bytes(rng.choice(b"ab") for _ in range(5000))]
    for raw in texts:
        plain = plain_chunks(raw)
        assert b"".join(plain) == raw and op.chunk_ends(raw) == [sum(map(len, plain[: k + 1])) for k in range(len(plain))]
        assert sum(x & 0xFF for x in op.chunks(raw)) == sum(map(len, set(plain)))
    for a in texts:
        for b in (texts[3][: len(texts[3]) // 2], texts[4][5000:], b""):
            mine, theirs = set(plain_chunks(a)), set(plain_chunks(b))
            share = sum(map(len, mine & theirs)) / sum(map(len, mine)) if mine else float(not theirs)
            assert abs(op.containment(op.chunks(a), op.chunks(b)) - share) < 1e-12


def test_chunks_shift():
    from widegrain.llm import fingerprints as op

    rng = random.Random(1)
    text = prose(rng, 3000).encode()
    ends = op.chunk_ends(text)
    assert ends[-1] == len(text) and all(b - a <= op.MOST for a, b in zip([0, *ends], ends, strict=False))
    assert op.containment(op.chunks(text), op.chunks(b"inserted " + text)) > 0.98
    assert op.decode(op.encode(op.chunks(text))) == op.chunks(text)
    assert op.chunk_ends(b"") == [] and op.chunk_ends(b"a") == [1]


def test_packing(table, rows, as_doc):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from widegrain.llm import packing as op

    rows = [*rows, as_doc(4001, "a <|endoftext|> b"), as_doc(4002, "<|endoftext|><|endoftext|>")]
    got = collect(op.pack_documents(table(rows), P.path("byte_bpe_50k.json"), P.PATTERN))
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expect = []
    for d, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expect.append((d, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=key) == sorted(expect, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r["length"] for r in got) // 1024) + 1


def test_best_two_fit_plan():
    from widegrain.llm.packing import Places, plan

    rng = random.Random(2)
    for _ in range(40):
        counts = Counter(rng.randrange(1, 65) for _ in range(rng.randrange(1, 400)))
        made = plan(counts, 64)
        used = Counter()
        for times, sizes in made:
            assert sum(s * k for s, k in sizes) <= 64
            for s, k in sizes:
                used[s] += times * k
        assert used == counts
        assert sum(t for t, _ in made) <= -(-sum(s * k for s, k in counts.items()) // 64) * 1.2 + 1
        assert Places(made).n_bins == sum(t for t, _ in made)
    # a greedy bin 50+10 leaves 4; 7+7 in place of 10 fill it
    assert plan({50: 1, 10: 1, 7: 2}, 64)[0][1] == [(50, 1), (7, 2)]


def test_byte_bpe(table, rows):
    import public_tokenizers as P
    import tiktoken

    from widegrain.llm import bpe as op

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op.load_ranks(path), special_tokens={})
    expect = Counter()
    for d, t, *_ in rows:
        ids = ref.encode_ordinary(t or "")
        expect[d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = collect(op.encode_documents(table(rows), path, P.PATTERN))
    assert Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in got) == expect


def test_bpe_appends_and_edits():
    import public_tokenizers as P

    from widegrain.llm import bpe as op

    bpe, _ = op.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = random.Random(3)
    for _ in range(200):
        raw = bytes(rng.choice(b"abcdeit n") for _ in range(rng.randrange(1, 30)))
        e = op.Editable(bpe, raw[:5])
        e.append(raw[5:])
        assert e.ids() == bpe.piece(raw)
        a = rng.randrange(len(raw))
        b = rng.randrange(a, len(raw) + 1)
        e.replace(a, b, b"the")
        assert e.ids() == bpe.piece(raw[:a] + b"the" + raw[b:])


def test_encoder_on_odd_white_space():
    import public_tokenizers as P
    import tiktoken

    from widegrain.llm import bpe as op

    bpe, cached = op.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\t\u00a0\u2003  ab'ésx.*12語🙂") for _ in range(rng.randrange(50))) for _ in range(800)]
    for text, raw in zip(texts, cached.raw_many(texts), strict=True):
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == ref.encode_ordinary(text), repr(text)


def test_url_filter(spark, tmp_path):
    from widegrain.llm import urls as op
    from widegrain.llm.queries import URL_RULES

    urls = [None, "", "no scheme", "https://A.Example.ORG/en/12?x", "http://example.org/es/1#a", "http://xexample.org/es/1", "https://b.com/fr/", "https://b.com/de/1", "https://b.com/dex", "ftp://com/fr/a", "http://org", "http://:80/", "https://x.net/?a://b.com/de/", "https://b.com/de/1"]
    df = spark.createDataFrame([(k if k != 3 else None, u, "<p>") for k, u in enumerate(urls)], "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))

    def plain(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
            path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
        fit = [(len(h + p), h + p, v) for h, p, v in URL_RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    expect = Counter((k if k != 3 else None, *plain(u)) for k, u in enumerate(urls))
    schema = "host string, path string, verdict string"
    for limit in (op.BROADCAST_ENTRIES, 0):  # both ways of the exact join
        op.BROADCAST_ENTRIES, before = limit, op.BROADCAST_ENTRIES
        got = collect(op.judge_urls(pages, spark.createDataFrame(URL_RULES, schema)))
        op.BROADCAST_ENTRIES = before
        assert Counter(tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in got) == expect
    assert all(r["verdict"] == "allow" for r in collect(op.judge_urls(pages, spark.createDataFrame([], schema))))


def test_url_filter_on_odd_tables(spark, tmp_path, monkeypatch):
    from widegrain.llm import urls as op

    schema = "page_id long, url string, row string, key string, keys string, host string, path string, entry string, verdict string, rule string"
    urls = [*(f"https://s{k}.hot.com/a/{k}" for k in range(300)), "https://" + "a." * 20_000 + "hot.com/b", "https://hot.com/" + "x/" * 50_000, "https://x.y.cold.org/a/b", "https://cold.org/a", "https://cold.org/a"]
    rules = [("hot.com", "/a/", "block"), ("hot.com", "/a/", "allow"), ("s7.hot.com", "/a/7", "allow"), ("y.cold.org", "/a", "block"), (None, "/a", "block"), ("cold.org", None, "block"), *((f"h{k}.net", f"/{k}", "block") for k in range(500))]

    def plain(url):
        host, path = url[8:].partition("/")[::2]
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and p and (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fit)[2:] if fit else (None, "allow")

    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    for name, some in (("some", urls), ("none", [])):
        made = spark.createDataFrame([(k, u, *"abcdefgh") for k, u in enumerate(some)], schema)
        made.write.parquet(str(tmp_path / name))
        expect = Counter((k, *plain(u)) for k, u in enumerate(some))
        pages = spark.read.parquet(str(tmp_path / name))
        # from files and out of a shuffle; with a filter that lets nearly all pass; by either join
        for docs, bits, limit in ((pages, None, op.BROADCAST_ENTRIES), (pages.repartition(3), None, 0), (pages, 512, 0)):
            monkeypatch.setattr(op, "BROADCAST_ENTRIES", limit)
            got = op.judge_urls(docs, listed, bits)
            assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
            assert Counter((r["page_id"], r["rule"], r["verdict"]) for r in got.collect()) == expect
    assert op.filter_bits(0) == op.LEAST_BITS and op.filter_bits(10**6) == 1 << 24 and op.filter_bits(10**12) == op.MOST_BITS


def test_candidate_keys():
    from widegrain.llm.urls import candidate_keys

    assert candidate_keys("a.b.c", "/xy", (1, 3, 9), 2) == ["b.c\t/", "b.c\t/xy", "c\t/", "c\t/xy"]
    assert candidate_keys("a.b.c", "/xy", (1,), 3) == candidate_keys("a.b.c", "/xy", (1,), 7) == ["a.b.c\t/", "b.c\t/", "c\t/"]
    assert candidate_keys("", "", (0,), 3) == [] and candidate_keys("a", "", (1,), 3) == [] and candidate_keys("a", "/", (1,), 0) == []


def test_blocked_bloom():
    import numpy as np

    from widegrain.llm.urls import BlockedBloom, _hashes

    keys = _hashes([f"k{k}" for k in range(5000)])
    bloom = BlockedBloom(1 << 17)
    bloom.add(keys[:2500])
    assert bloom.has(keys[:2500]).all() and bloom.has(keys[2500:]).mean() < 0.01
    assert not bloom.has(np.zeros(0, np.uint64)).any()


def exact_expected(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        order = sorted(ids, key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(order):
            out[i, keep, len(ids), k == len(order) - 1, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


def test_exact_dedup(table, rows):
    from widegrain.llm import exact_dedup as op

    got = collect(op.dedup_report(table(rows)))
    assert Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got) == exact_expected(rows)
    docs = table(rows)
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns and {r["digest"] for r in kept.collect()} == {"x"}
    assert Counter((r["text"] or "") for r in kept.collect()) == Counter({t or "": 1 for _, t, *_ in rows})


def test_exact_dedup_checks_bytes(table, rows):
    from pyspark.sql import functions as F

    from widegrain.llm import exact_dedup as op

    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    weak_binary = lambda text: weak(text).cast("binary")
    got = op._once(table(rows), weak_binary).decisions().select("doc_id", "keep_id", "group_size", "kept").collect()
    assert Counter(map(tuple, got)) == Counter({k[:4]: 0 for k in exact_expected(rows)} | Counter(k[:4] for k in exact_expected(rows).elements()))


def test_exact_dedup_state_meets_a_second_arrival(spark, table, rows, tmp_path):
    from pyspark.sql import functions as F

    from widegrain.llm import exact_dedup as op

    first, second, third = rows[:40], rows[30:70], rows[60:]
    for digest in (op.sha256_digest, lambda text: F.substring(F.sha2(text, 256), 1, 1).cast("binary")):
        folder = str(tmp_path / f"state{digest is op.sha256_digest}")
        seen = []
        for some in (first, second, third):
            seen += some
            # a new object each time: all that is known is in the folder
            state = op.DedupState(spark, folder, digest=digest)
            got = op.dedup_report(table(some), state).select("doc_id", "keep_id", "group_size", "kept").collect()
            assert Counter(map(tuple, got)) == Counter(k[:4] for k in exact_expected(seen).elements())
        assert state.arrivals() == 3
    with pytest.raises(ValueError):
        op._once(table(first)).add(table(second))


def test_exact_dedup_of_rows_without_a_place(table, rows):
    from widegrain.llm import exact_dedup as op

    docs = table(rows).repartition(3)
    got = collect(op.dedup_report(docs))
    assert Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got) == exact_expected(rows)
    assert Counter((r["text"] or "") for r in op.keep_one(docs).collect()) == Counter({t or "": 1 for _, t, *_ in rows})


def test_ppm_scores(table, rows):
    from pyspark.sql import functions as F

    from widegrain.llm import lm_score as op
    from widegrain.llm.toxicity import remainder

    got = collect(op.score_documents(table(rows), F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))))
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split()
    c = Counter(w for d, t, *_ in rows if not held(d) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    expect = sorted((str(d), held(d), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for d, t, *_ in rows)
    mine = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert mine == expect
    assert all(r["score"] < 0 for r in got)


def plain_ppm(train, text):
    """The model by nested counters, one byte at a time; also the sum of all probabilities at the last place."""
    from widegrain.llm import lm_score as op

    tables = [{} for _ in range(op.ORDER + 1)]
    for x in train:
        b = b"\xff" * op.ORDER + x + b"\xff"
        for i in range(op.ORDER, len(b)):
            for k in range(op.ORDER + 1):
                tables[k].setdefault(b[i - k : i], Counter())[b[i]] += 1

    def p(b, i, s):
        out, seen = 1.0, set()
        for k in range(op.ORDER, -1, -1):
            left = {t: c for t, c in tables[k].get(b[i - k : i], {}).items() if t not in seen}
            if left:
                total = sum(left.values())
                if s in left:
                    return out * (left[s] - op.GIVEN) / total
                out *= op.GIVEN * len(left) / total
                seen |= set(tables[k][b[i - k : i]])
        return out / (256 - len(seen))

    b = b"\xff" * op.ORDER + text + b"\xff"
    said, score = [{} for _ in op.LONG], 0.0
    for i in range(op.ORDER, len(b)):
        at = i - op.ORDER
        told = next(((m[text[at - n : at]], trust) for m, n, trust in zip(said, op.LONG, (0.99, 0.8), strict=True) if at >= n and text[at - n : at] in m), None)
        for m, n in zip(said, op.LONG, strict=True):
            if at >= n:
                m[text[at - n : at]] = b[i]
        x = p(b, i, b[i])
        if told:
            x = told[1] if told[0] == b[i] else (1 - told[1]) * x / (1 - p(b, i, told[0]))
        score += math.log10(x)
    return score, sum(p(b, len(b) - 1, s) for s in range(256))


def test_ppm_against_counters(monkeypatch):
    import numpy as np

    from widegrain.llm import lm_score as op

    rng = random.Random(6)
    train = [prose(rng, 40).encode() for _ in range(20)]
    g, c = op.counted(np.concatenate([op.grams_of(x) for x in train]))
    low = op.low_levels(*op.short_grams(g, c))
    whole_trie = op.Ppm(g, c, low)
    trust = (0.99, 0.8)

    def by_parts(grams):
        """Each gram from the part of the trie that its context's end leads to."""
        out = np.zeros(len(grams))
        for k in np.unique(op.bucket_of(grams)):
            mine, theirs = op.bucket_of(grams) == k, op.bucket_of(g) == k
            out[mine] = op.Ppm(g[theirs], c[theirs], low).log10(grams[mine])
        return out

    for text in [b"", b"the", prose(rng, 30).encode(), b"abcdefghijklmnopqrstuvw xyz " * 4, bytes(range(1, 120)), (prose(rng, 20) + " zq ").encode() * 3]:
        score, whole = plain_ppm(train, text)
        assert abs(whole - 1) < 1e-9
        for slice_ in (op.SLICE, 40):  # also in slices, whose contexts look back over their borders
            monkeypatch.setattr(op, "SLICE", slice_)
            for log10 in (whole_trie.log10, by_parts):
                assert abs(op.score_texts([text, text], log10, trust)[1] - score) < 1e-3 + 1e-5 * abs(score)
            # what gathering leaves for scoring
            for some in ([text], [text, b"the", text]):
                known = [(level, said) for _, _, level, said, _ in op.placed(some)]
                level, said = (np.concatenate(x) for x in zip(*known, strict=True))
                told = np.flatnonzero(level >= 0)
                got = op.score_group(b"".join(some), np.array([len(x) for x in some]), told, level[told], said[told], whole_trie.log10, trust)
                assert abs(got[-1] - score) < 1e-3 + 1e-5 * abs(score)


def test_ppm_table_of_logs():
    import numpy as np

    from widegrain.llm import lm_score as op

    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 1 << 48, 5_000).astype(np.uint64))
    logs = rng.random(len(grams)).astype(np.float32)
    assert np.array_equal(op.Logs(grams, logs).log10(grams[::-1]), logs[::-1].astype(float))
    assert np.array_equal(op._from6(op._bytes6(grams).tobytes()), grams)


def test_ppm_blocks_give_the_same_scores(table, rows, monkeypatch):
    from pyspark.sql import functions as F

    from widegrain.llm import lm_score as op
    from widegrain.llm.toxicity import remainder

    key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["score"], 3))
    held = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    one = collect(op.score_documents(table(rows), held))
    # more blocks; and contexts that count as crowded, so that they are added up and answered in several places
    assert sorted(map(key, collect(op.score_documents(table(rows, 7), held)))) == sorted(map(key, one))
    monkeypatch.setattr(op, "ENTRIES", 20)
    assert sorted(map(key, collect(op.score_documents(table(rows, 7), held)))) == sorted(map(key, one))
    # all texts held out: nothing is known, and every byte is as likely as any other
    none = collect(op.score_documents(table(rows[:9]), F.lit(True)))
    assert all(r["n_known"] == 0 and r["score"] < 0 for r in none)


def test_toxicity(spark, table, as_doc):
    from widegrain.llm import toxicity as op

    rng = random.Random(8)
    bad = {"en": ["vile", "rotten"], "de": ["grausig", "grausent"]}
    made, labels = [], []
    for k in range(600):
        lang, toxic = rng.choice(["en", "de"]), rng.random() < 0.2
        words = prose(rng, rng.randrange(10, 60)).split()
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad[lang]))
        made.append(as_doc(k, " ".join(words), lang))
        if k % 3:
            labels.append((k, int(toxic)))
    truth = {d: any(w in t for b in bad.values() for w in b) for d, t, *_ in made}
    made += [as_doc(None, None), as_doc(1000, ""), as_doc(0, made[0][1])]
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = collect(op.score_documents(table(made), lab))
    assert len(got) == len(made) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum((r["predicted"] == 1) == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    left = op.reject_toxic(table(made), lab)
    assert "score" in left.columns and 0.05 < 1 - left.count() / len(made) < 0.3
    none = collect(op.score_documents(table(made[:5]), lab.limit(0)))
    assert all(r["score"] == 0 for r in none)


def test_toxicity_against_plain_convolution():
    import numpy as np

    from widegrain.llm import toxicity as op

    rng = random.Random(21)
    texts = [prose(rng, rng.randrange(0, 40)) + (" vile" if k % 3 == 0 else "") for k in range(60)] + ["", "a", "Vile, ROTTEN!"]
    model = op.fit(texts, [int("vile" in t) for t in texts])

    def logit(text):
        """Word by word and filter by filter."""
        vectors = [sum(model.embedding[p].astype(float) for p in op.parts_of(w)) for w in [*(op.plain(t) for t in text.lower().split()), "", ""]]
        pooled = []
        for span, filters in zip(op.SPANS, model.filters, strict=True):
            for f in range(op.FILTERS):
                pooled.append(max(sum(float(vectors[k + j] @ filters[j, :, f]) for j in range(span) if k + j < len(vectors)) for k in range(len(vectors))))
        return sum(max(0.0, x + b) * w for x, b, w in zip(pooled, model.filter_bias, model.weights, strict=True)) + model.bias

    got = op.Scorer(model).logits(texts)
    assert np.allclose(got, [logit(t) for t in texts], atol=1e-4)


def test_toxicity_learns_from_the_least_text(spark, table, as_doc):
    from widegrain.llm import toxicity as op

    rng = random.Random(22)
    made = [as_doc(k, prose(rng, 12) + (" vile" if k % 2 else "")) for k in range(60)]
    twice = [*made, *(as_doc(k, "zz " + prose(rng, 12)) for k in range(60))]
    lab = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    fitted = []
    for rows, files in ((twice, 1), (list(reversed(twice)), 3)):
        model = op.train(table(rows, files), lab)
        fitted.append((model.embedding.sum(), model.shift, sorted(model.thresholds.items())))
    assert fitted[0] == fitted[1]
    got = collect(op.score_documents(table(made), lab))
    assert all(isinstance(r["rejected"], bool) for r in got)


def test_toxicity_calibrates_on_all(spark, table, as_doc, monkeypatch):
    from widegrain.llm import toxicity as op

    # 20 of 1,000 labelled toxic documents are in a rare language, and no sample of 100 and 200 has 8 of them to hold back
    rng = random.Random(12)
    made, labels = [], []
    for k in range(3000):
        toxic, rare = k % 3 == 0, k % 50 == 0
        words = prose(rng, rng.randrange(10, 30)).split()
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten"]))
        made.append(as_doc(k, " ".join(words), "xx" if rare else "en"))
        labels.append((k, int(toxic)))
    monkeypatch.setattr(op, "SAMPLE_TOXIC", 100)
    monkeypatch.setattr(op, "SAMPLE_OTHER", 200)
    docs, lab = table(made), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = {}
    whole = op.calibrate_on_all
    monkeypatch.setattr(op, "calibrate_on_all", lambda model, labelled, fitted: seen.update(rows=labelled.count(), fitted=sum(fitted.values())) or whole(model, labelled, fitted))
    model = op.train(docs, lab)
    assert set(model.thresholds) == {"en", "xx"}
    # all that may be learned from is either fitted or calibrated on
    assert seen["rows"] + seen["fitted"] == sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(3000))


def test_cut_of_counts():
    import numpy as np

    from widegrain.llm import toxicity as op

    rng = np.random.default_rng(3)
    y = (rng.random(4000) < 0.2).astype(int)
    logits = rng.normal(0, 1, 4000) + 2 * y
    f1 = lambda cut: 2 * (y[logits >= cut]).sum() / ((logits >= cut).sum() + y.sum())
    bins, counts = op._dense(np.floor(logits * op.BINS).astype(int), y, np.ones(4000, int))
    assert f1(op.cut_of_counts(bins, counts, (1.0, 1.0))) > f1(op._best_cut(logits, y)) - 0.005
    # a class that stands for more weighs more: more clean documents move the cut up
    assert op.cut_of_counts(bins, counts, (10.0, 1.0)) > op.cut_of_counts(bins, counts, (1.0, 1.0))


def jaccard_expected(rows, width, percent):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(rows)))
    find = lambda k: k if group[k] == k else find(group[k])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    least = {}
    for k, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return Counter((d, len(sets[k]), least.get(find(k)) if sets[k] else d) for k, (d, *_) in enumerate(rows))


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard(table, rows, as_doc, width, percent):
    from widegrain.llm import jaccard_groups as op

    rng = random.Random(9)
    more = list(rows)
    for f in range(4):  # families of near copies about the threshold
        base = prose(rng, 150).split()
        for k in range(40):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
            more.append(as_doc(1000 * (f + 1) + k, " ".join(w)))
    op.MEMBERS, before = 8, op.MEMBERS
    got = collect(op.jaccard_components(table(more), width, percent))
    op.MEMBERS = before
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == jaccard_expected(more, width, percent)


def test_jaccard_keeps_one(table, rows):
    from widegrain.llm import jaccard_groups as op

    docs = table(rows)
    kept = op.one_of_each(docs)
    groups = jaccard_expected(rows, 5, 80)
    assert kept.columns == docs.columns
    named = {c for (_, n, c) in groups if n and c is not None}
    assert Counter(r["doc_id"] for r in kept.collect() if (r["text"] or "").split() and r["doc_id"] is not None) == Counter(dict.fromkeys(named, 1))


def test_block_opens_what_qualifies(monkeypatch):
    import numpy as np

    from widegrain.llm import jaccard_groups as op

    compared = []
    similar = op.similar
    monkeypatch.setattr(op, "similar", lambda a, b, percent: compared.append(1) or similar(a, b, percent))
    near = [np.unique(np.append(np.arange(100), 1000 + k)).astype(np.uint64) for k in range(20)]
    block = op.Block(85)
    links = []
    for k, tokens in enumerate(near):
        links += [(k, other) for other in block.ask(k, tokens)]
        block.add(k, k, tokens)
    # each near copy is linked once, and members of its component are not compared again
    assert [k for k, _ in links] == list(range(1, 20)) and len(compared) == 19
    assert len(block.union) == 120
    # what the union doesn't cover far enough is not compared with any member
    assert not list(block.ask(99, np.arange(50, 150).astype(np.uint64))) and len(compared) == 19
    # a class that links two components names each of them once
    block = op.Block(50)
    for k, tokens in enumerate([range(10), range(10, 20), range(9)]):
        block.add(k, k, np.array(tokens, dtype=np.uint64))
    assert list(block.ask(7, np.arange(20).astype(np.uint64))) == [0, 1]


def test_jaccard_large_bands(spark, table, as_doc, monkeypatch):
    from widegrain.llm import jaccard_groups as op

    rng = random.Random(4)
    base, docs = prose(rng, 150).split(), []
    for k in range(60):  # near copies, many of which meet without being linked
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        docs.append(as_doc(k, " ".join(w)))
    expected = jaccard_expected(docs, 5, 80)
    rows, save = {}, op.save

    def counted(df, tag):
        out = save(df, tag)
        rows[tag] = out.count()
        return out

    monkeypatch.setattr(op, "save", counted)
    monkeypatch.setattr(op, "MEMBERS", 2)
    for queries in (512, 8):
        monkeypatch.setattr(op, "QUERIES", queries)
        got = collect(op.jaccard_components(table(docs), 5, 80))
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected
        if queries == 512:  # a band of so few classes is one block, whose members ask no other
            assert rows["blocks"] > 60 and rows["asking"] == 0


def test_block_compares_what_is_linked(monkeypatch):
    import numpy as np

    from widegrain.llm import jaccard_groups as op

    compared = []
    similar = op.similar
    monkeypatch.setattr(op, "similar", lambda a, b, percent: compared.append(1) or similar(a, b, percent))
    block = op.Block(80)
    for k in range(40):  # each shares 80 of its 100 tokens with all others: enough for the union, not for a link
        block.add(k, k, np.unique(np.append(np.arange(80), np.arange(1000 + 20 * k, 1020 + 20 * k))).astype(np.uint64))
    assert not list(block.ask(99, np.arange(100).astype(np.uint64))) and not compared
    assert list(block.ask(99, np.append(np.arange(80), np.arange(1100, 1119)).astype(np.uint64))) == [5] and len(compared) == 1


def test_components_with_hubs(spark, monkeypatch):
    from widegrain.llm import components as op

    monkeypatch.setattr(op, "LINKS", 2)
    links = [(50, k) for k in range(51, 80)] + [(7, 50), (7, 7), (1, 2), (2, 1), (2, 3), (3, 90), (90, 4)]
    got = {r["node"]: r["comp"] for r in op.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 7 for k in (7, *range(50, 80))} | {k: 1 for k in (1, 2, 3, 4, 90)}


def test_miss_bound():
    from widegrain.llm.jaccard_groups import BANDS, MISS, rows_of_band

    for percent in (80, 85, 90):
        assert (1 - (percent / 100) ** rows_of_band(percent)) ** BANDS <= MISS


def repeats_expected(rows):
    raws = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[p : p + 200] for b in raws for p in range(len(b) - 199))
    out = Counter()
    for (d, *_), b in zip(rows, raws, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out[d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_array_dedup(table, rows, as_doc):
    from widegrain.llm import suffix_dedup as op

    rng = random.Random(10)
    passage = prose(rng, 45)
    more = [*rows, *(as_doc(2000 + k, prose(rng, 20) + " " + passage + " " + prose(rng, 25)) for k in range(30)), as_doc(3000, "ab" * 500), as_doc(3001, "b" + "ab" * 120 + "x")]
    expect = repeats_expected(more)
    for segments, piece in ((op.SEGMENTS, op.PIECE), (3, 500)):  # also with split groups and texts
        before = op.SEGMENTS, op.PIECE
        op.SEGMENTS, op.PIECE = segments, piece
        got = collect(op.repeat_report(table(more)))
        op.SEGMENTS, op.PIECE = before
        assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == expect
    docs = table(more)
    left = op.remove_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(more)
    assert all(passage not in (r["text"] or "") for r in left.collect())


def test_rows_without_a_place(table, rows):
    from widegrain.llm import jaccard_groups, suffix_dedup

    docs = table(rows).repartition(3)
    got = collect(jaccard_groups.jaccard_components(docs, 4, 85))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == jaccard_expected(rows, 4, 85)
    got = collect(suffix_dedup.repeat_report(docs))
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == repeats_expected(rows)


def test_suffix_array():
    from widegrain.llm.suffix_dedup import suffix_array

    rng = random.Random(11)
    for _ in range(500):
        s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda k: s[k:])
    assert suffix_array([0, 1] * 300)[:2] == [598, 596]


PAGE = "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><header>Top</header><nav><ul><li><a href=/a>menu {k}</a></li><li>m</li></ul></nav><div class='cookie-notice'>cookies</div><main><article><h1>Head {k}</h1><p>First &amp; <b>bold</b> {k}\n text.<p>Second<br>line</p>{extra}<ul><li>One<li>Two</ul></article></main><aside>side</aside><section id=comments><p>reader {k}</p></section><form><input>go</form><footer>&copy; foot</footer></body></html>"


def test_html(spark, tmp_path):
    from widegrain.llm import html_wrappers as op

    rows = []
    for k in range(20):
        rows.append((k, f"https://h{k % 2}.example/x/{k}", PAGE.replace("{k}", str(k)).replace("{extra}", "<blockquote><p>quote</p></blockquote>" if k % 3 else "")))
    rows += [(100, None, "<p>alone"), (101, "https://h0.example/", None), (102, "https://h0.example/cut", PAGE.split("Second")[0]), (103, "https://h1.example/", ""), (104, "https://plain.example/", "just text &lt;b&gt;"), (104, "https://plain.example/", "just text &lt;b&gt;"), (105, "https://h1.example/", "<div class=ad>x</div><p>out of <i>art</i>icle</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    got = collect(op.extract_pages(spark.read.parquet(str(tmp_path / "pages"))))
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    text = {r["page_id"]: r["text"] for r in got}
    for k in range(20):
        # blocks are joined by two line feeds, as the contract of op10 says
        assert text[k] == "\n\n".join([f"Head {k}", f"First & bold {k} text.", "Second line", *(["quote"] if k % 3 else []), "One", "Two"])
    assert text[100] == "alone" and text[101] == "" and text[103] == "" and text[104] == "just text <b>" and text[105] == "out of article"
    assert text[102].startswith("Head") and text[102].endswith("text.")
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_wrapper_inference():
    from widegrain.llm import html_wrappers as op

    w = op.Wrapper()
    for n in (1, 3):
        w.add(op.Page("<article><h1>x</h1>" + "<p>a</p>" * n + ("<i>z</i>" if n == 3 else "") + "</article>"))
    assert op.render(w.tree) == "<article><h1>#</h1>(<p>#</p>)+(<i>#</i>)?</article>"
    merged = op.Wrapper.load(w.dump()).merge(op.Wrapper.load(w.dump()))
    assert op.render(merged.tree) == op.render(w.tree) and merged.pages == 4


def wrapper_of(sources):
    """A wrapper merged from two parts, as tasks make them."""
    from widegrain.llm import html_wrappers as op

    parts = [op.Wrapper(), op.Wrapper()]
    for k, source in enumerate(sources):
        parts[k % 2].add(op.Page(source))
    return op.Wrapper.load(parts[0].dump()).merge(op.Wrapper.load(parts[1].dump()))


def test_wrapper_decides_extraction():
    from widegrain.llm import html_wrappers as op

    # texts that all pages share stand under the same tags as those that differ
    pages = [f"<div>Home</div><div class=x><p>Our shop</p></div><div class=y><p>Tale {k}</p><p>of {k}</p></div><ul><li>Terms<li>Imprint</ul>" for k in range(12)]
    w = wrapper_of(pages)
    assert [op.extract(p, w) for p in pages] == [f"Tale {k}\n\nof {k}" for k in range(12)]
    # one block of a page is fixed only as a whole
    mixed = [f"<div>Signed by <b>author {k}</b></div><p>Powered by <b>us</b></p>" for k in range(12)]
    assert op.extract(mixed[3], wrapper_of(mixed)) == "Signed by author 3"
    # paths are the same, but the place in the tree differs: the first paragraph is the host's own
    first = [f"<p>Welcome</p><div>d {k}</div><p>Story {k}</p>" for k in range(12)]
    assert op.extract(first[5], wrapper_of(first)) == "d 5\n\nStory 5"


def test_wrapper_counts_pages():
    from widegrain.llm import html_wrappers as op

    # what stands on one page only is that page's own, whatever its tag
    pages = [f"<div>Home</div><p>Tale {k}</p>" + ("<blockquote>quote</blockquote><pre>code</pre><h3>part</h3>" if k == 4 else "") + "<div><i>Imprint</i></div>" for k in range(20)]
    w = wrapper_of(pages)
    assert op.extract(pages[4], w) == "Tale 4\n\nquote\n\ncode\n\npart" and op.extract(pages[5], w) == "Tale 5"
    # ids that differ from page to page
    names = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    pages = [f"<div>Home {len(n)}</div><div id=post-{n}><p>Tale of {n}</p></div>" for n in names]
    w = wrapper_of(pages)
    assert all(f"Tale of {n}" in op.extract(p, w) for p, n in zip(pages, names, strict=True))
    # half of the pages, and nearly all of them
    pages = [f"<p>Tale {k}</p>" + "<pre>half</pre>" * (k % 2) + "<ul><li>Imprint</ul>" * (k != 7) for k in range(20)]
    w = wrapper_of(pages)
    assert op.extract(pages[3], w) == "Tale 3\n\nhalf" and op.extract(pages[7], w) == "Tale 7\n\nhalf"
    # neighbours that fold in the wrapper aren't counted twice
    nodes = op.fold([["p", "?", [["#", "1", [5, 6]]]], ["p", "?", [["#", "1", [5, 6]]]]])
    assert nodes == [["p", "+", [["#", "1", [5, 6]]]]]


@pytest.mark.parametrize(
    "around",
    [
        '<form id="aspnetForm">{}</form>',
        '<body class="has-sidebar">{}</body>',
        '<body class="search">{}</body>',
        '<div class="layout header-fixed">{}</div>',
        '<div class="overlay">{}</div>',
    ],
)
def test_marks_around_articles(around):
    from widegrain.llm import html_wrappers as op

    page = around.format("<nav>menu</nav><article><h1>Head</h1><p>Text</p></article><footer>foot</footer>")
    assert op.extract(page, None) == "Head\n\nText"


def test_marks():
    from widegrain.llm import html_wrappers as op

    # values of other attributes, and names that only end like one
    assert op.extract('<article><p>See <a href="/hidden-figures">this</a>, <a title="a hidden gem">that</a>, <a href="/p?id=comment">a</a> <a href=/p?class=ad>b</a> <i data-id="reply">and</i> more.</p></article>', None) == "See this, that, a b and more."
    assert op.extract('<article><h2 class="section-header">A</h2><h2 class="header">B</h2><p>C</p></article>', None) == "A\n\nB\n\nC"
    # marks that are meant
    assert op.extract('<article><p>A</p><div class="cookie-notice">x</div><div hidden>y</div><p style="display: none">z</p><section id="comments"><article>w</article></section></article>', None) == "A"
    assert op.extract('<article>A</article><section id="comments"><article class="x">w</article></section><div class="related"><article>v</article></div>', None) == "A"
    assert op.extract("<div hidden><article>A</article></div><p>B</p>", None) == "B"
    # a main region under a mark, articles only under marks, a page that is a form
    assert op.extract('<div class="header"><main>A</main></div><p>B</p>', None) == "A"
    assert op.extract('<div class="widget"><article>A</article></div><p>B</p>', None) == "A"
    assert op.extract('<form id="aspnetForm"><div>A</div><nav>n</nav><p>B</p></form>', None) == "A\n\nB"
    assert op.extract("<p>A</p><form>send</form>", None) == "A"


def test_wrapper_of_few_pages():
    from widegrain.llm import html_wrappers as op

    # no region, no telling class: what two pages share is the host's own, what one page has alone is not
    for n in range(2, 8):
        pages = [f"<div>Home</div><div><span>Our shop</span></div><h2>Tale {k}</h2><p>It goes on {k * 7}</p><div><i>Imprint</i></div>" for k in range(n)]
        w = wrapper_of(pages)
        assert [op.extract(p, w) for p in pages] == [f"Tale {k}\n\nIt goes on {k * 7}" for k in range(n)]
        # without the tree nothing tells them apart
        assert op.extract(pages[0], None) == "Home\n\nOur shop\n\nTale 0\n\nIt goes on 0\n\nImprint"
    one = wrapper_of(pages[:1])
    assert op.extract(pages[0], one) == op.extract(pages[0], None)
    # copies fix nothing
    assert op.extract(pages[0], wrapper_of([pages[0]] * 3)) == op.extract(pages[0], None)


def test_wrapper_inside_regions():
    from widegrain.llm import html_wrappers as op

    # a header of the article stays where it fills a slot and goes where the host's pages share it; so do texts that are links only
    pages = [f"<article><header><p>The Daily Example</p><h1>Title {k}</h1></header><ul><li><a href=/>Start</a><li><a href=/b>About</a></ul><p>Text {k}</p><p>Shared line</p></article>" for k in range(5)]
    w = wrapper_of(pages)
    assert [op.extract(p, w) for p in pages] == [f"Title {k}\n\nText {k}\n\nShared line" for k in range(5)]
    assert op.extract(pages[2], None) == "The Daily Example\n\nTitle 2\n\nStart\n\nAbout\n\nText 2\n\nShared line"
    assert op.extract('<article><p class="related-work">A</p><header><h1>B</h1></header></article>', None) == "A\n\nB"
    # an article element that all pages share, beside text that differs
    pages = [f"<article><p>Join our club</p></article><div><p>Story {k}</p><p>and {k} more</p></div>" for k in range(4)]
    assert [op.extract(p, wrapper_of(pages)) for p in pages] == [f"Story {k}\n\nand {k} more" for k in range(4)]
    # menus of links that differ from page to page
    pages = [f"<div><ul><li><a href=/x>x{k}</a><li><a href=/y>y{k}</a></ul></div><p>Story <a href=/z>{k}</a></p>" for k in range(4)]
    assert [op.extract(p, wrapper_of(pages)) for p in pages] == [f"Story {k}" for k in range(4)]


def test_wide_levels_are_loosened():
    from widegrain.llm import html_wrappers as op

    rng = random.Random(14)
    pages = ["<div class=top>Home</div>" + "".join(f"<div class=c{rng.choice('abcdefgh')}{chr(97 + j % 26)}{chr(97 + j // 26)}>t{k} {j}</div>" for j in range(150)) + f"<section><p>Story {k}</p></section>" for k in range(12)]
    w = wrapper_of(pages)
    assert len(w.tree) <= op.WIDE and all(f"Story {k}" in op.extract(p, w) and f"t{k} 149" in op.extract(p, w) for k, p in enumerate(pages))
    long = "<div class='" + "x y" * 60
    assert op.Page(long + "a'>A</div>").tree[0][0] != op.Page(long + "b'>A</div>").tree[0][0]


def plain_article(source):
    """A page's text by the standard library's parser: blocks of the article, without marked elements."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.away, self.blocks, self.parts = 0, 0, [], []

        def cut(self):
            self.blocks.append(" ".join("".join(self.parts).split()))
            self.parts = []

        def handle_starttag(self, tag, attrs):
            self.away += tag in ("nav", "footer", "script", "style") or dict(attrs).get("class") == "ad"
            self.inside += tag == "article"
            if tag == "br":
                self.parts.append(" ")
            elif tag in ("p", "h1", "article", "div", "ul", "li"):
                self.cut()

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "article", "div", "ul", "li"):
                self.cut()
            self.inside -= tag == "article"
            self.away -= tag in ("nav", "footer", "script", "style")

        def handle_data(self, data):
            if self.inside and not self.away:
                self.parts.append(data)

    r = Reader()
    # adverts are simple elements here
    import re

    r.feed(re.sub(r'<div class="ad">[^<]*</div>', "", source))
    r.close()
    r.cut()
    return "\n\n".join(b for b in r.blocks if b)


def test_html_against_plain_extractor(spark):
    import os

    from widegrain.llm import queries as q

    at = "/root/testdata/sf0.01"
    if not os.path.exists(at):
        pytest.skip("no test data")
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    got = q.op10_html_extraction(spark, at).collect()
    assert Counter(r["page_id"] for r in got) == Counter(sources.keys())
    assert all(r["text"] == plain_article(sources[r["page_id"]] or "") and r["n_chars"] == len(r["text"]) for r in got)


def test_html_tables(spark, tmp_path, monkeypatch):
    from widegrain.llm import html_wrappers as op

    schema = "page_id long, url string, html string, host string, wrapper string, text string, kind int, salt int, pages string"
    rows = [(k, f"https://h{min(k, 30) % 3}.example/{k}", f"<div>Home</div><p>Tale {k}</p>", "x", "y", "z", 7, 8, "w") for k in range(60)]
    rows += [rows[5], (None, "https://h0.example/a", "<p>no id</p>", *rows[0][3:]), (61, "https://h1.example/long", "<div>Home</div>" + "<p>word &amp; <b>more</b></p>" * 20_000, *rows[0][3:]), (62, "https://h1.example/deep", "<div>" * 3_000 + "deep" + "</div>" * 10, *rows[0][3:])]
    for name, some in (("some", rows), ("none", [])):
        spark.createDataFrame(some, schema).repartition(3).write.parquet(str(tmp_path / name))
        pages = spark.read.parquet(str(tmp_path / name))
        small = collect(op.extract_pages(pages))
        # the way for more wrappers than a broadcast may hold, with hosts that are dealt to several places
        monkeypatch.setattr(op, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(op, "PAGES_AT_ONCE", 4)
        large = collect(op.extract_pages(pages))
        monkeypatch.undo()
        key = lambda r: (str(r["page_id"]), r["url"], r["text"], r["n_chars"])
        assert sorted(map(key, small)) == sorted(map(key, large)) and len(small) == len(some)
        text = Counter((r["page_id"], r["text"]) for r in small)
        assert all(text[k, f"Tale {k}"] == 1 + (k == 5) for k in range(60 if some else 0))
    assert text == Counter()


@pytest.mark.parametrize("name", ["fingerprints", "packing", "bpe", "dedup", "lm", "toxicity", "jaccard", "suffix"])
def test_empty_tables(spark, table, name):
    import public_tokenizers as P
    from pyspark.sql import functions as F

    from widegrain.llm import bpe, exact_dedup, fingerprints, jaccard_groups, lm_score, packing, suffix_dedup, toxicity

    docs = table([])
    made = {
        "fingerprints": lambda: fingerprints.fingerprint_documents(docs),
        "packing": lambda: packing.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN),
        "bpe": lambda: bpe.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
        "dedup": lambda: exact_dedup.dedup_report(docs),
        "lm": lambda: lm_score.score_documents(docs, F.lit(False)),
        "toxicity": lambda: toxicity.score_documents(docs, spark.createDataFrame([], "doc_id long, toxic int")),
        "jaccard": lambda: jaccard_groups.jaccard_components(docs),
        "suffix": lambda: suffix_dedup.repeat_report(docs),
    }[name]()
    assert made.count() == 0


def test_pipeline(spark, tmp_path, as_doc, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= docs.count()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    ids = Counter(r["doc_id"] for r in packed.where("piece = 0").collect())
    exact = {k[0] for k in exact_expected(rows) if k[3]}
    assert set(ids) <= exact and 1 not in ids and all(n == 1 for d, n in ids.items() if d is not None)

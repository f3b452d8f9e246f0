"""Operators on whole texts against brute force, and on odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import chat_format, decontaminate, language_id, line_dedup, pii, queries, sentencepiece_sampling, suffix_dedup, token_binary

from ..conftest import DATA, same_rows

BPE, PIECES = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


def test_registered_sql(spark, duck):
    from tagloom.llm.oracles import oracle_sql

    for name, sql in oracle_sql().items():
        same_rows(queries.queries()[name](spark, DATA), duck, sql)


# 1: token ids


@pytest.mark.parametrize("ids", [[], [5], list(range(300)), [7] * 1000, [0, 2**32 - 1] * 100, list(np.random.default_rng(0).integers(0, 50257, 5000))])
def test_blocks_round_trip(ids):
    ends = [len(ids) // 3, len(ids)]
    for percentile in (1, 50, 90, 100):
        got, at = token_binary.unpack(token_binary.pack(np.array(ids, np.uint32), np.array(ends), percentile))
        assert got.tolist() == list(ids) and at.tolist() == ends
    with pytest.raises(ValueError):
        token_binary.unpack(b"x" * 64)


def brute_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    return [e.ids + [0] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_library():
    odd = ["a <|endoftext|> b", "a<|endoftext|>b<|endoftext|>", "<|endof text|>", "", " ", "\n", "a  b", " a\n\nb ", "a\tb c", "x y z", "<|endoftext|> a", "a \n b", "it's we'll  'd", "\x1c a", "é ü 😀", "a b c", "end "]
    own = token_binary.Encoder(BPE, 0)
    for _ in range(2):
        ids, ends = own.encode(odd)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == brute_ids(odd)
    assert 50256 in brute_ids(["a <|endoftext|> b"])[0]


def test_added_tokens_with_spaces(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.add_special_tokens([AddedToken("<end of turn>"), AddedToken("<x>", lstrip=True)])
    tokenizer.save(str(tmp_path / "t.json"))
    own, texts = token_binary.Encoder(str(tmp_path / "t.json"), 0), ["a <end of turn> b", "<end of", "b  <x> c", "of turn>", "plain <end of turn>"]
    for _ in range(2):
        ids, ends = own.encode(texts)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [e.ids + [0] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]



def test_tokens_match_brute_force(spark, docs, texts):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_binary(spark, DATA).collect()}
    start = 0
    for (doc, _), ids in zip(sorted(texts.items()), brute_ids([t for _, t in sorted(texts.items())]), strict=True):
        assert got[doc] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_tokens_of_odd_rows(spark, odd, tmp_path):
    path = f"file://{tmp_path}/t"
    token_binary.write(odd, path, BPE, segment_tokens=64)
    rows = token_binary.read(spark, path).orderBy("start").collect()
    want = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    assert [(r.doc_id, list(r.ids)) for r in rows] == list(zip([k for k, _ in want], brute_ids([t for _, t in want]), strict=True))
    assert token_binary.round_trip(odd.limit(0), BPE).count() == 0


# 2: line runs


def brute_lines(rows, run):
    seen, out = set(), {}
    for id, text in sorted({(-(2**63) if i is None else i, t or "") for i, t in rows}, key=lambda x: (x[0], hashlib.md5(x[1].encode()).hexdigest())):
        lines = text.split("\n")
        gone = set()
        for k in range(len(lines) - run + 1):
            key = tuple(lines[k : k + run])
            if key in seen:
                gone |= set(range(k, k + run))
            seen.add(key)
        out[id, text] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_runs(spark, odd, docs, run):
    for df in (odd, docs):
        want = brute_lines([(r.doc_id, r.text) for r in df.collect()], run)
        rows = line_dedup.deduplicated(df, run=run).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert want[-(2**63) if r.row.doc_id is None else r.row.doc_id, r.row.text or ""] == (r.n_lines, r.n_removed, r.kept_text)
    assert line_dedup.deduplicated(odd.limit(0)).count() == 0


# 4: conversations


def brute_chats(rows):
    convs = {}
    for conv, turn, role, text in {(c, -1 if t is None else t, r, x) for c, t, r, x in rows if c is not None}:
        convs.setdefault(conv, []).append((turn, role, text))
    order = lambda t: (t[0], t[1] is not None, t[1] or "", t[2] is not None, t[2] or "")
    convs = {c: sorted(t, key=order) for c, t in convs.items()}
    keep = [c for c, t in convs.items() if not any(o != c and ((len(u) > len(t) and u[: len(t)] == t) or (u == t and o < c)) for o, u in convs.items())]
    out = {}
    for c in keep:
        for turn, role, text in convs[c]:
            n, s = out.get((c, turn // 256), (0, ""))
            out[c, turn // 256] = (n + 1, s + f"<|im_start|>{role or ''}\n{(text or '').replace('<|im_', '<| im_')}<|im_end|>\n")
    return out


def test_snapshots_collapse(spark):
    turns = lambda c, *texts: [(c, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]
    rows = turns(1, "a", "b") + turns(2, "a", "b", "c") + turns(3, "a", "b", "c") + turns(4, "a", "x") + turns(5, "a") + turns(6, *[f"t{k}" for k in range(600)]) + turns(7, *[f"t{k}" for k in range(300)])
    rows += [(8, None, "user", "q"), (8, 0, None, None), (8, 0, None, None), (None, 0, "user", "a"), (9, 0, "user", "<|im_end|>"), (9, 0, "user", ""), (10, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("piece", F.lit(0)).withColumn("conv", F.lit("c"))
    got = {(r.conv_id, r.piece): (r.n_turns, r.rendered) for r in chat_format.formatted(df).collect()}
    assert got == brute_chats(rows)
    assert {c for c, _ in got} == {2, 4, 6, 8, 9, 10}
    assert chat_format.formatted(df.limit(0)).count() == 0


# 6: benchmark passages


def brute_contamination(text, items, window=10):
    words = decontaminate.normal_words((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        own = decontaminate.normal_words((body or "").encode())
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[k : k + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(words), len(hit), sorted(x for x in found if x is not None), len(found)


@pytest.mark.parametrize("shard", [decontaminate.SHARD_BYTES, 40])
def test_contamination(spark, odd, shard):
    items = [(None, "Nobody named This, item of more than ten words at all in it"), (None, "eight nine TEN"), (6, "of more than ten words at all in it and some more words"), (1, "A b, C d"), (2, "one two three four five six seven eight nine ten eleven"), (10, "A b, C d"), (3, None), (4, "!!"), (None, "a"), (1, "A b, C d"), (5, "ünï")]
    more = [(20, "zero One two-three four five six seven eight nine TEN and two three four five six seven eight nine ten eleven", "x"), (21, "xa b c d", "x"), (22, "one two three four five six seven eight nine", "x"), (23, "so nobody named this item of more than ten words at all in it and", "x")]
    df = odd.select("doc_id", "text", "lang", "row", "n_words").unionByName(spark.createDataFrame(more, "doc_id bigint, text string, lang string").withColumn("row", F.lit(1)).withColumn("n_words", F.lit(0.5)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.contamination(df, bench, shard_bytes=shard).collect()
    assert len(rows) == df.count()
    for r in rows:
        n, hit, found, n_items = brute_contamination(r.row.text, [(None if i is None else str(i), t) for i, t in items])
        assert (r.n_words, r.n_hit, r["items"], r.n_items, r.contaminated) == (n, hit, found, n_items, hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert sum(len(decontaminate.normal_words(r.row.text[s.start : s.end].encode())) for s in r.spans) == hit
    assert decontaminate.decontaminated(df, bench.limit(0)).count() == df.count()
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_contamination_of_random_words(spark, monkeypatch, window):
    """Few words, so that windows overlap, repeat and share blocks; long items come in pieces."""
    rng = np.random.default_rng(window)
    words = lambda n, k: " ".join(rng.choice(list("abcde"[:k]), n))
    items = [(k, words(int(rng.integers(1, 40)), 2 + k % 3)) for k in range(12)] + [(None, words(30, 4))]
    rows = [(k, words(int(rng.integers(1, 200)), 5)) for k in range(40)] * 2
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {k: brute_contamination(t, [(None if i is None else str(i), x) for i, x in items], window) for k, t in rows}
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(decontaminate)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 5)
    try:
        for shard in (decontaminate.SHARD_BYTES, 100):
            got = decontaminate.contamination(df, bench, window=window, shard_bytes=shard).collect()
            assert len(got) == len(rows) and all((r.n_words, r.n_hit, r["items"], r.n_items) == want[r.row.doc_id] for r in got)
    finally:
        cloudpickle.unregister_pickle_by_value(decontaminate)


# 7: sampled pieces


def test_pieces_are_lossless_and_reproducible(spark, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = sentencepiece_sampling.sampled(odd, PIECES).collect()
    assert len(rows) == odd.count() and all(r.lossless for r in rows)
    again = sentencepiece_sampling.sampled(odd.repartition(7), PIECES).collect()
    key = lambda r: (str(r.row.doc_id), r.row.text or "")
    assert {key(r): r.ids for r in rows} == {key(r): r.ids for r in again}
    assert all(library.decode(list(r.ids)) == (r.row.text or "") for r in rows if "\x00" not in (r.row.text or "") and "▁" not in (r.row.text or "") and len(r.row.text or "") < 9000)
    other = sentencepiece_sampling.sampled(odd, PIECES, seed=99).collect()
    assert {key(r): r.ids for r in rows} != {key(r): r.ids for r in other}
    assert sentencepiece_sampling.sampled(odd.limit(0), PIECES).count() == 0


def test_pieces_across_words_are_refused(monkeypatch):
    import sentencepiece

    class Model(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, k):
            return "a▁b" if k == 500 else super().id_to_piece(k)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    with pytest.raises(ValueError, match="span words"):
        sentencepiece_sampling.Vocabulary(PIECES, 1.0)


def test_samples_follow_the_lattice():
    import sentencepiece

    lattice = sentencepiece_sampling.Lattice(sentencepiece_sampling.Vocabulary(PIECES, 0.7))
    model, weight = sentencepiece.SentencePieceProcessor(model_file=PIECES), lattice.vocabulary.weight
    pieces = {model.id_to_piece(k): k for k in range(model.vocab_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))}

    def paths(w):
        return {(): 0.0} if not w else {(pieces[w[:k]], *p): x + weight[pieces[w[:k]]] for k in range(1, len(w) + 1) if w[:k] in pieces for p, x in paths(w[k:]).items()}

    want = paths("▁there")
    total, n = sum(map(math.exp, want.values())), 30_000
    ids, at = lattice.sample(["there"] * n, sentencepiece_sampling.row_seeds(list(range(n)), 3))
    got = Counter(tuple(x.tolist()) for x in np.split(ids, at[1:-1]))
    assert set(got) <= set(want)
    assert all(abs(got.get(p, 0) / n - math.exp(x) / total) < 0.015 for p, x in want.items())


# 8: languages


def test_language_accuracy_held_out(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(big.where("doc_id % 2 = 0"), "lang", most=300)
    rows = language_id.identify(big.where("doc_id % 2 = 1"), model).join(big.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    assert sum(r.text_lang == r.true for r in rows) / len(rows) >= 0.98 and sum(r.accepted for r in rows) / len(rows) >= 0.99


def test_language_evidence(spark):
    from pyspark.sql import functions as F

    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(big, "lang")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    url, html = F.col("url"), F.col("html")
    parts = pages.select(language_id.host_of(url).alias("h"), language_id.suffix_of(url).alias("s"), language_id.declared_in(html).alias("d")).collect()
    assert all(p.h and p.d and p.s for p in parts)
    rows = language_id.identify(pages, model, "page_id", language_id.visible(html), declared=language_id.declared_in(html), suffix=language_id.suffix_of(url), host=language_id.host_of(url)).collect()
    assert len(rows) == pages.count() and all(r.accepted for r in rows)
    # Where the text says nothing much, markup and host decide.
    weak = spark.createDataFrame([(k, "de la", "fr", "h.example") for k in range(40)], "doc_id int, text string, declared string, host string")
    strong = spark.createDataFrame([(100 + k, r.text, "fr", "h.example") for k, r in enumerate(big.where("lang = 'fr'").limit(40).collect())], "doc_id int, text string, declared string, host string")
    both = language_id.identify(weak.unionByName(strong), model, declared=F.col("declared"), host=F.col("host"))
    assert {r.lang for r in both.collect()} == {"fr"}


def brute_languages(rows, model):
    """Ids with language, confidence, acceptance and the text's own guess, from (id, text, declared, suffix, host)."""
    names, table = model.languages, model.table.astype(float).tolist()
    kinds, soft = len(names), lambda s: [math.exp(x - max(s)) / sum(math.exp(y - max(s)) for y in s) for x in s]
    flat = [math.log(0.99 / (kinds - 1))] * (kinds - 1) + [math.log(0.01)]
    seen = []
    for i, text, declared, suffix, host in rows:
        codes = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
        grams = [codes[k] << 16 | codes[k + 1] << 8 | codes[k + 2] for k in range(len(codes) - 2)]
        grams = [(g * 0x9E3779B1 % 2**32) >> 16 for g in grams if g != 0x202020]
        score = [sum(table[g][k] for g in grams) * min(1, 60 / max(len(grams), 1)) for k in range(kinds)]
        mark = (declared or "").strip(" ")[:2].lower()
        seen.append((i, score, soft([a + b for a, b in zip(score, flat, strict=True)]), mark if re.fullmatch("[a-z]{2}", mark) else "", suffix or "", host or ""))
    total = lambda fits: [sum(r[2][k] for r in seen if fits(r)) for k in range(kinds)]
    whole, out = total(lambda r: True), []
    sums = {f: total(lambda r: (r[3],) == f[1:] if f[0] == "d" else r[4] == f[1] if f[0] == "s" else (r[4], r[5]) == f[1:]) for f in {x for r in seen for x in (("d", r[3]), ("s", r[4]), ("h", r[4], r[5]))}}  # noqa: B023
    for i, score, own, mark, suffix, host in seen:
        less = lambda key: [max(a - b, 0) for a, b in zip(sums[key], own, strict=True)]  # noqa: B023, E731
        prior = [(w + 1) / (sum(whole) + kinds) for w in whole]
        for given, key in ((suffix, ("s", suffix)), (host, ("h", suffix, host))):
            if given:
                rest = less(key)
                prior = [(a + 20 * b) / (sum(rest) + 20) for a, b in zip(rest, prior, strict=True)]
        final = [a + math.log(b) for a, b in zip(score, prior, strict=True)]
        if mark:
            final = [f + math.log((a + 0.5) / (max(w - o, 0) + 0.5 * 677)) for f, a, w, o in zip(final, less(("d", mark)), whole, own, strict=True)]
        post, bare = soft(final), not any(score)
        best = post.index(max(post))
        out.append((i, "und" if bare else names[best], 0 if bare else round(max(post), 6), not bare and best < kinds - 1 and max(post) >= 0.5, "und" if bare else names[own.index(max(own))]))
    return sorted(out, key=str)


def test_languages_match_brute_force(spark, docs):
    rng = np.random.default_rng(5)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    texts = [(r.doc_id, r.text[: int(rng.integers(2, 60))]) for r in docs.collect()][:120] + [(None, "de la"), (500, None), (501, " \n"), (502, "12 !"), (503, "ab"), (504, "zzz qqq xxjj"), (504, "zzz qqq xxjj")]
    rows = [(i, t, pick(None, "fr", "EN-gb", " de", "x1", "", "fr"), pick(None, "fr", "org/en", ""), pick(None, "a.fr", "b.org", "")) for i, t in texts]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, declared string, suffix string, host string").repartition(3)
    model = language_id.fit(docs, "lang", most=60)
    for kinds in ((), ("declared",), ("suffix",), ("host",), ("declared", "suffix", "host")):
        got = language_id.identify(df, model, **{k: F.col(k) for k in kinds}).collect()
        want = brute_languages([(i, t, *(x if k in kinds else None for k, x in zip(("declared", "suffix", "host"), e, strict=True))) for i, t, *e in rows], model)
        for a, b in zip(sorted(((r.doc_id, r.lang, r.confidence, r.accepted, r.text_lang) for r in got), key=lambda r: str((r[0], r[1], round(r[2], 5)))), sorted(want, key=lambda r: str((r[0], r[1], round(r[2], 5)))), strict=True):
            assert a[:2] == b[:2] and a[3:] == b[3:] and abs(a[2] - b[2]) < 1e-5


def test_registered_languages_match_brute_force(spark, docs):
    model = language_id.fit(docs, "lang")
    key = lambda r: (r[0] is None, r[0])
    close = lambda got, want: all(a[:2] == b[:2] and a[3:] == b[3:] and abs(a[2] - b[2]) < 1e-5 for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True))
    got = [(r.doc_id, r.lang, r.confidence, r.accepted, r.text_lang) for r in queries.op8_language_id(spark, DATA).collect()]
    assert close(got, brute_languages([(r.doc_id, r.text, None, None, r.source) for r in docs.collect()], model))
    got = [(r.page_id, r.lang, r.confidence, r.accepted, r.text_lang) for r in queries.language_id_pages(spark, DATA).collect()]
    url, html = F.col("url"), F.col("html")
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", language_id.visible(html), language_id.declared_in(html), language_id.suffix_of(url), language_id.host_of(url)).collect()
    assert close(got, brute_languages([tuple(r) for r in pages], model))


def test_nothing_to_fit(spark, docs):
    for rows in (docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string"))):
        model = language_id.fit(rows, "lang")
        assert model.languages == ["und"]
        found = language_id.identify(docs, model, declared=F.col("lang"), host=F.col("source")).collect()
        assert len(found) == docs.count() and not any(r.accepted for r in found) and {r.lang for r in found} == {"und"}


def test_language_of_odd_rows(spark, odd):
    model = language_id.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "lang")
    found = language_id.identify(odd, model, declared=F.col("lang"), host=F.col("source"))
    rows = found.collect()
    assert len(rows) == odd.count()
    assert all(not r.accepted and r.lang == "und" for r in rows if r.doc_id in (2, 3, 4))
    kept = language_id.accepted(odd, model, declared=F.col("lang"), host=F.col("source"))
    assert kept.columns == odd.columns
    assert language_id.identify(odd.limit(0), model).count() == 0


# 9: byte repeats


def brute_bytes(rows, length, order):
    seen, out = set(), {}
    for id, text in sorted({(-(2**63) if i is None else i, t or "") for i, t in rows}, key=order):
        b = text.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[id, text] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def check_bytes(df, **options):
    sums = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    by_text = {t or "": h for (_, t), h in sums.items()}
    want = brute_bytes(sums, options.get("length", 100), lambda x: (x[0], by_text[x[1]]))
    rows = suffix_dedup.removal(df, **options).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert want[-(2**63) if r.row.doc_id is None else r.row.doc_id, r.row.text or ""] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)


def test_byte_repeats(docs, odd):
    check_bytes(docs)
    check_bytes(odd)
    assert suffix_dedup.removal(odd.limit(0)).count() == 0


def test_byte_repeats_of_hot_pieces(spark, monkeypatch):
    """A short line that many texts share, among different neighbours: its windows are dealt by their own hashes."""
    rng = np.random.default_rng(3)
    line = "".join(rng.choice(list("abcdefgh"), 60))
    rows = [(k, "".join(rng.choice(list("abcdefgh"), 30)) + line + "xyz"[: k % 4] + "".join(rng.choice(list("ab"), 6)) + "tail of the text, which is the same in all of them and long enough " * 2) for k in range(300)]
    check_bytes(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), length=100)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(suffix_dedup)
    try:
        monkeypatch.setattr(suffix_dedup, "HOT_IN_TASK", 4)
        monkeypatch.setattr(suffix_dedup, "HOT_IN_BUCKET", 2)
        check_bytes(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), length=100)
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)


@pytest.mark.parametrize("limits", [{"MEET_ROWS": 7, "HOT_IN_TASK": 4, "HOT_IN_BUCKET": 2}, {"MEET_ROWS": 2, "HOT_IN_BUCKET": 3}, {"MEET_ROWS": 5, "CHUNK_BYTES": 20, "HOT_IN_TASK": 2}])
def test_byte_repeats_in_pieces(spark, monkeypatch, limits):
    """Hashes of more runs than are held together, some with many classes, over many tasks and batches."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdef"), 12)) for _ in range(6)]
    line = "".join(rng.choice(list("abcdefgh"), 150))
    rows = [(k, " ".join(rng.choice(words, 12)) + (line if k % 3 else line[: 40 + k]) + " ".join(rng.choice(words, 9))) for k in range(150)] + [(200 + k, line * 3) for k in range(30)]
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(suffix_dedup)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for name, value in limits.items():
            monkeypatch.setattr(suffix_dedup, name, value)
        check_bytes(spark.createDataFrame(rows, "doc_id int, text string").repartition(5), length=50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        cloudpickle.unregister_pickle_by_value(suffix_dedup)


def test_two_stage_order():
    rng = np.random.default_rng(1)
    for trial in range(60):
        n, letters, depth = int(rng.integers(1, 400)), int(rng.integers(1, 5)), int(rng.integers(1, 40))
        text = (rng.integers(0, letters, n) + (97 if trial % 2 else 0)).astype(np.uint8)
        order, body = suffix_dedup.two_stage_order(text, depth), text.tobytes()
        assert sorted(order.tolist()) == list(range(n))
        keys = [body[k : k + depth] for k in order]
        assert keys == sorted(keys)
        shared = suffix_dedup.common(text, order[:-1], order[1:], depth)
        for a, b, k in zip(keys[:-1], keys[1:], shared, strict=True):
            assert a[:k] == b[:k] and (k == min(len(a), len(b)) or a[k] != b[k])


def test_columns_of_any_name(spark):
    """Names with dots, spaces, marks and backticks pass through; names of the operators' own don't clash."""
    df = spark.createDataFrame([(1, "some text of a few words", 1, 2, 3, 4)], "doc_id bigint, text string, `a.b` int, `c d;e:f` int, `g``h` int, `row` int")
    bench = spark.createDataFrame([(1, "few words")], "item_id bigint, text string")
    for rows in (line_dedup.deduplicated(df), suffix_dedup.removal(df), decontaminate.contamination(df, bench), decontaminate.contamination(df, bench, shard_bytes=4), sentencepiece_sampling.sampled(df, PIECES)):
        assert list(rows.first().row.asDict()) == df.columns
    assert decontaminate.decontaminated(df, bench.limit(0)).columns == df.columns
    model = language_id.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "lang")
    assert language_id.accepted(df, model).columns == df.columns
    assert language_id.identify(df, model).count() == 1


# 10: personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_pii(text):
    spans, counts = [], []
    for kind, pattern in PATTERNS.items():
        found = []
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if fits:
                found.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(len(found))
        spans += found
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest()), spans


def test_base_spans(spark, odd, docs):
    tricky = ["a@b.c_d@e.f x", "1.2.3.4.5 300.1.1.1 001.2.3.4", "4111 1111-1111 1111 4111111111111112", "+1 (743) 555-3824 +49 30 1234567 +1", "😀 a.b+c@d-e.fr, 10.0.0.1.", "x@y @a.b a@.b", "+12 345 678 90 4111111111111111", "1-2-3", "0000000000000", "+999999999999999999", "a@b.c@d.e"]
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(tricky)], "doc_id bigint, text string")
    df = odd.select("doc_id", "text").unionByName(more).unionByName(docs.select("doc_id", "text"))
    want = {}
    for r in df.collect():
        want.setdefault(r.doc_id, []).append(brute_pii(r.text))
    rows = pii.personal_data(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        match = [spans for w, spans in want[r.doc_id] if w == (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)]
        assert match and set(match[0]) <= set(r.spans.split(",")) | {""}
    assert pii.personal_data(odd.limit(0)).count() == 0


def test_context_finds_unseen_identifiers(spark):
    """Addresses in another shape, where the same words stand beside them as beside known ones."""
    rows = [(k, f"please reach me at user{k}@mail{k}.example.com whenever you like, item {k}") for k in range(30)]
    rows += [(100 + k, f"please reach me at user{k}(at)mail.example(dot)com whenever you like") for k in range(3)]
    rows += [(200, "it costs 12(at)3.example(dot)com only in this odd sentence")]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k in range(3):
        text = rows[30 + k][1]
        spans = out[100 + k].spans.split(",")
        a, b = map(int, spans[0].split(":")[1:])
        assert out[100 + k].n_added == 1 and text[a:b] == f"user{k}(at)mail.example(dot)com" and out[100 + k].n_email == 0
    assert out[200].n_added == 0 and all(out[k].n_added == 0 for k in range(30))


def test_all_trusted_contexts_count(spark):
    """More trusted words than 2,000, of which those beside an unseen address score least."""
    rows = [(k, f"w{chr(97 + k // 4 % 26)}{chr(97 + k // 104 % 26)}{chr(97 + k // 2704)}q user{k}@mail.example") for k in range(8400)]
    rows += [(10_000 + k, f"zzzz last{k}@mail.example yyyy") for k in range(5)] + [(20_000, "zzzz k9(at)mail.example(dot)com yyyy")]
    out = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[20_000].spans == "email:5:31" and sum(r.n_added for r in out.values()) == 1


def test_spelt_out_addresses_without_digits(spark):
    names = ["jane", "john", "mary"]
    rows = [(k, f"please reach me at user{k}@mail{k}.example.com whenever you like") for k in range(30)]
    rows += [(100 + k, f"please reach me at {n}(at)mail.example(dot)com whenever you like") for k, n in enumerate(names)]
    rows += [(200 + k, f"please reach me at ({n}[at]mail.example[dot]com) whenever you like") for k, n in enumerate(names)]
    rows += [(300, "it is sold by jim(at)shop.example(dot)com only in this odd sentence"), (301, "( [ (a [at (at [at )")]
    out = {r.doc_id: (r.n_added, r.spans) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k in range(3):
        assert out[100 + k] == (1, "email:19:47") and out[200 + k] == (1, "email:20:48")
    assert out[300] == out[301] == (0, "")


def brute_discovery(rows):
    """Added spans by document, from texts whose tokens are parted by single spaces and have no marks around them."""
    seeds, free = set(), []  # (kind, value, side, word); (doc, start, value, words)
    plain = lambda w: re.sub("[0-9]", "0", w).lower()
    key = lambda w: "#" + hashlib.md5(plain(w).encode()).hexdigest() if len(w) > pii.WORD_CHARS else plain(w)
    shape = lambda v: re.sub("[^A-Za-z]+|[A-Za-z]+", lambda m: "a" if m.group().isalpha() else re.sub("[0-9]+", lambda d: "D" if len(d.group()) < 3 else "M" if len(d.group()) < 5 else "N", m.group()), v)
    fixed = lambda v: next((k for k in pii.KINDS if re.search(pii.SHAPES[k], v)), None)
    for doc, text in rows:
        at, words = 0, text.split(" ")
        spans = brute_pii(text)[1]
        for k, w in enumerate(words):
            around = {(side, key(x)) for side, x in (("L", words[k - 1] if k else ""), ("R", words[k + 1] if k + 1 < len(words) else "")) if x}
            hit = [s.split(":")[0] for s in spans if s.split(":")[1:] == [str(at), str(at + len(w))]]
            if hit:
                seeds |= {(hit[0], w, *a) for a in around}
            elif re.search("[0-9@]|[(]at[)]", w):
                free.append((doc, at, w, around))
            at += len(w) + 1
    graph = {(v, *a) for _, _, v, around in free for a in around}
    values, known = {v for _, _, v, _ in free}, {}
    for _ in range(pii.ROUNDS):
        more = seeds | {(known[v], v, s, w) for v, s, w in graph if v in known}
        trust = {}
        for s, w in {x[2:] for x in more}:
            all_ = sum(x[2:] == (s, w) for x in more) + sum(x[1:] == (s, w) and x[0] not in known for x in graph)
            for kind in pii.KINDS:
                n = sum(x[2:] == (s, w) and x[0] == kind for x in more)
                if n >= pii.MIN_SUPPORT and n / all_ >= pii.MIN_TRUST:
                    trust[kind, s, w] = n / all_
        score = {(v, k): 1 - math.prod(max(1 - trust[k, s, w], 0.01) for x, s, w in graph if x == v and (k, s, w) in trust) for v in values - set(known) for k in pii.KINDS}
        voted = {vk: x for vk, x in score.items() if x >= pii.MIN_SCORE}
        fresh = {}
        for (v, k), x in sorted(voted.items(), key=lambda y: (round(y[1], 9), -pii.KINDS.index(y[0][1]))):
            here = sum(shape(u) == shape(v) and j == k for u, j in [*voted, *known.items()])
            if fixed(v) == k or here >= pii.MIN_FORMS and here >= pii.MIN_FORM_SHARE * sum(shape(u) == shape(v) for u in values):
                fresh[v] = k
        if not fresh:
            break
        known |= fresh
    out = {}
    for doc, at, v, _ in free:
        if v in known:
            out.setdefault(doc, set()).add(f"{known[v]}:{at}:{at + len(v)}")
    return out


def planted(n, seed):
    """Texts with seeds in telling and in common contexts, and identifiers of other makes beside the same words."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(rng.choice(list("0123456789"), k))
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    makes = {
        "email": (lambda: f"{word()}@{word()}.org", lambda: f"{word()}(at){word()}", "mailto"),
        "phone": (lambda: f"+{num(11)}", lambda: f"tel/{num(3)}/{num(6)}", "dial"),
        "ip": (lambda: f"10.{num(1)}.{num(2)}.{int(rng.integers(256))}", lambda: f"0x{num(8)}", "host"),
        "card": (lambda: "4111111111111111", lambda: f"{num(4)}.{num(4)}.{num(4)}.{num(4)}", "visa"),
    }
    rows = []
    for k in range(n):
        out = [word() for _ in range(4)]
        for kind in list(makes):
            seed_, unseen, near = makes[kind]
            pick = int(rng.integers(20))
            if pick < 12:
                out += [near if pick else "see", seed_(), f"{near}end" if pick < 10 else word()]
            elif pick == 12:
                out += [near, unseen(), f"{near}end" if rng.random() < 0.7 else word()]
            elif pick > 15:
                out += ["see", unseen() if rng.random() < 0.1 else f"item{num(2)}", word()]
        rows.append((k, " ".join(out)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_discovery_matches_brute_force(spark, seed):
    rows = planted(320, seed) + [(1000 + k, f"{'x' * 100} u{k}@v.org {'y' * 70}") for k in range(9)] + [(1009, f"{'x' * 100} a(at)b.example {'y' * 70}"), (1010, f"{'x' * 99} c(at)d.example {'y' * 71}")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want, base = brute_discovery(rows), {k: set(brute_pii(t)[1]) for k, t in rows}
    assert {k: set(r.spans.split(",")) - {""} - base[k] for k, r in got.items() if r.n_added} == want
    assert {s.split(":")[0] for spans in want.values() for s in spans} >= {"email", "ip"} and 1009 in want and 1010 not in want


def test_words_beside_matches_are_whole(spark):
    """The word beside a match counts whole, however long it is or far away."""
    far = " " * 60
    rows = [(k, f"contact{far}u{k}@v.org{far}now") for k in range(5)] + [(9, f"contact{far}jo(at)v.example{far}now"), (10, f"{'q' * 50}contact jo(at)w.example {'q' * 50}")]
    out = {r.doc_id: r.n_added for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[9] == 1 and out[10] == 0


def test_discovery_among_real_texts(spark):
    """Identifiers of a make that no fixed shape has, planted in all of the texts of sf0.01: all are found, nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    n = F.col("doc_id")
    more = F.when(n % 10 < 8, F.concat(F.lit(" kontakt user"), n, F.lit("@mail.example bitte"))).when(n % 20 == 9, F.concat(F.lit(" kontakt acct/"), 10000 + n, F.lit("/x bitte"))).otherwise(F.lit(""))
    got = pii.personal_data(docs.select("doc_id", F.concat("text", more).alias("text"))).where("n_added > 0").collect()
    want = {r.doc_id for r in docs.where("doc_id % 20 = 9").collect()}
    assert {r.doc_id for r in got} == want and all(r.n_added == 1 for r in got)


def test_sample_of_sparse_labels(spark, monkeypatch):
    """Few labels among many rows, one language rare: all that is usable is fitted, as evenly as it can be."""
    seen = []
    monkeypatch.setattr(language_id.Model, "fit", classmethod(lambda cls, texts, labels: seen.append(Counter(labels))))
    rows = [(k, {0: "en", 1: "en-GB", 2: "fr"}.get(k % 100), f"text {k}") for k in range(3000)] + [(5000, "de", "ein"), (5001, "de", ""), (5002, "de", None)]
    df = spark.createDataFrame(rows + [(None, "en", "same")] * 50, "doc_id bigint, lang string, text string")
    language_id.fit(df, "lang", most=60)
    language_id.fit(df, "lang", most=20)
    language_id.fit(df.limit(0), "lang")
    assert seen[0] == {"en": 29, "fr": 30, "de": 1} or seen[0] == {"en": 30, "fr": 29, "de": 1}
    assert sum(seen[1].values()) == 20 and seen[1]["de"] == 1 and abs(seen[1]["en"] - seen[1]["fr"]) <= 1
    assert not seen[2]

"""Document operators on small tables: brute-force versions, round trips, held-out accuracy and odd rows."""
import collections
import functools
import hashlib
import math
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sphereframe.llm import (decontaminate, fingerprints, jaccard_join, language, lm_score, packing, quality, queries,
                             secret_scan, token_store, tokens, warc)
from sphereframe.llm.common import rows_at_once, table

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
EXTRA = ", n_words bigint, score double, class_id bigint, kind string, start bigint, ids bigint, part int, fingerprint string"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint" + EXTRA
PROSE = "the quick brown fox jumps over the lazy dog while the cat sleeps under an old oak tree in the garden"
LONG = " ".join(f"word{i % 997} and{i}" for i in range(60_000))


def odd_rows():
    texts = [(1, PROSE), (2, None), (3, ""), (4, PROSE), (4, PROSE), (None, "no id here at all, but words"), (5, LONG),
             (6, "   \n\t "), (7, PROSE.replace("lazy", "sleepy")), (8, "Ünïcode — “quotes” ÉTÉ 日本語 \U0001F600 ok"),
             (9, "x"), (10, "1234 5678 !!"), (11, "ΑΣ a\x1cb"), (12, "password = 'Tr0ub4dor&3xQz91' token: abcdefghijklmnop")]
    return [(i, t, "en" if i and i % 2 else None, None, None, None, 0.5, None, "k", None, 3, None, None) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()]


def result(spark, tmp_path, name):
    """A registered query once written, as the driver reads it."""
    path = str(tmp_path / name)
    queries.QUERIES[name](spark, DATA).write.parquet(path)
    return spark.read.parquet(path).collect()


# ----------------------------------------------------------------------------- fingerprints
@needs_data
def test_fingerprint_query_against_plain_python(spark, small, tmp_path):
    rows = {r.doc_id: r for r in result(spark, tmp_path, "op1_fingerprints")}
    docs = sorted(small)
    prints = [fingerprints.fingerprint(t) for _, t in docs]
    assert len(rows) == len(docs)
    for k, (i, text) in enumerate(docs):
        after, row = docs[(k + 1) % len(docs)][1], rows[i]
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert int(row.fingerprint, 16) == prints[k]
        assert row.near_edited == 1 - (prints[k] ^ int(row.edited_fingerprint, 16)).bit_count() / 64
        assert row.near_next == 1 - (prints[k] ^ prints[(k + 1) % len(docs)]).bit_count() / 64
        assert row.near_docs == sum((p ^ prints[k]).bit_count() <= 3 for p in prints) - 1
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()]) + 0.1


def test_permuted_tables_find_all_near_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40)
    prints = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(8)]
    df = spark.createDataFrame([(fingerprints._signed(p),) for p in prints], "fingerprint bigint")
    for blocks, keep in ((5, 2), (6, 3), (4, 1)):
        for r in fingerprints.near_counts(df, 3, blocks, keep).collect():
            own = r.fingerprint & ((1 << 64) - 1)
            assert r.near == sum(p != own and (p ^ own).bit_count() <= 3 for p in prints) and r.copies == prints.count(own)
    with pytest.raises(ValueError):
        fingerprints.near_counts(df, 3, 4, 2)


@pytest.mark.parametrize("members", [8192, 60])
def test_hot_buckets_are_dealt_out_without_losing_pairs(spark, members):
    """Most fingerprints share their first 40 bits, so three of the ten tables have one bucket for all of them."""
    rng = np.random.default_rng(8)
    same = (rng.integers(0, 1 << 24, 500).astype(np.uint64) & np.uint64(0x3FF0FF)) << np.uint64(40) | np.uint64(0x1234567890)
    prints = np.concatenate([same, same[:50], same[:100] ^ np.uint64(5), rng.integers(0, 1 << 63, 50).astype(np.uint64)]).view(np.int64)
    rows = spark.createDataFrame([(int(p),) for p in prints], "fingerprint bigint")
    copies = collections.Counter(prints.tolist())
    mask = (1 << 64) - 1
    want = {a: (n, sum(m for b, m in copies.items() if b != a and ((a ^ b) & mask).bit_count() <= 3)) for a, n in copies.items()}
    got = {r.fingerprint: (r.copies, r.near) for r in fingerprints.near_counts(rows, members=members).collect()}
    assert got == want and sum(n for _, n in want.values()) > 500


def test_fingerprints_of_odd_rows(odd, empty):
    rows = fingerprints.edits(odd).collect()
    assert len(rows) == odd.count() and fingerprints.edits(empty).count() == 0
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 4)}) == 1
    by = {r.doc_id: r for r in rows}
    assert by[2].n_chars == by[3].n_chars == 0 and by[3].edited_sha256 == hashlib.sha256(b"").hexdigest()
    one = fingerprints.edits(odd.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.near_counts(fingerprints.fingerprints(empty)).count() == 0


# ----------------------------------------------------------------------------- language
@needs_data
def test_language_is_learned_and_predicted_by_text_only(spark, odd, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    net = language.fit(docs, learn="crc32(cast(doc_id as binary)) % 5 != 0", documents=120)
    held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    got = language.predict(held, net).join(held.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() > 0.95 * got.count()
    rows = {r.doc_id: r for r in language.predict(odd, net).collect()}
    assert rows[2].lang_pred == rows[3].lang_pred == rows[10].lang_pred == "und" and rows[2].score == 0
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[1].lang_pred in net.names
    assert language.predict(empty, net).count() == 0 and language.fit(empty) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}


def test_network_learns_a_pattern():
    rng = np.random.default_rng(0)
    rows, labels = rng.integers(1, 256, (200, 16)).astype(np.uint8), rng.integers(0, 2, 200)
    rows[labels == 1, 3:6] = 200  # a pattern that only one class has
    net = language.train(rows, labels, ["a", "b"], epochs=15)
    assert (net.probabilities(rows).argmax(axis=1) == labels).mean() > 0.95


# ----------------------------------------------------------------------------- Jaccard join
def brute_groups(docs, threshold=0.8):
    sets = [set(jaccard_join.shingles(t or "").tolist()) for _, t in docs]
    n, links, parent = len(docs), [0] * len(docs), list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in range(n):
        for b in range(a + 1, n):
            same = (docs[a][1] or "") == (docs[b][1] or "")
            both = len(sets[a] & sets[b])
            if same or (sets[a] and sets[b] and both / (len(sets[a]) + len(sets[b]) - both) >= threshold):
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = collections.defaultdict(list)
    for i in range(n):
        if docs[i][0] is not None:
            least[root(i)].append(docs[i][0])
    return [(docs[i][0], min(least[root(i)], default=None), links[i]) for i in range(n)]


@needs_data
def test_jaccard_groups_equal_brute_force(spark, small, tmp_path):
    got = sorted(tuple(r) for r in result(spark, tmp_path, "op3_jaccard_join"))
    assert got == sorted(brute_groups(small))


@pytest.mark.parametrize("block", [1 << 18, 200])
def test_large_groups_of_near_copies_are_split_without_losing_links(spark, block):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    docs = []
    for i in range(60):
        words = list(base)
        for k in rng.choice(120, rng.integers(0, 4), replace=False):
            words[k] = f"new{i}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, " ".join(f"q{i}x{k}" for k in range(50))) for i in range(5)]
    got = jaccard_join.groups(spark.createDataFrame(docs, "doc_id bigint, text string"), block=block)
    assert sorted(tuple(r) for r in got.select("doc_id", "class_id", "links").collect()) == sorted(brute_groups(docs))


def test_many_short_near_copies_come_in_blocks_of_bounded_members(spark):
    buckets = spark.createDataFrame([(30_000, 390_000), (1 << 18, 1 << 18), (60, 1 << 20), (2, 5)], "members bigint, size bigint")
    assert [r[0] for r in buckets.select(jaccard_join._parts()).collect()] == [15, 132, 4, 1]
    base = " ".join(f"t{k}" for k in range(16))  # 17 words, the last one running: 12 of 13 shingles shared
    docs = [(i, f"{base} n{i}") for i in range(60)]
    got = jaccard_join.groups(spark.createDataFrame(docs, "doc_id bigint, text string"), members=20)
    assert sorted(tuple(r) for r in got.select("doc_id", "class_id", "links").collect()) == sorted(brute_groups(docs))


def test_jaccard_of_odd_rows(odd, empty):
    docs = [(r[0], r[1]) for r in odd_rows()]
    got = jaccard_join.groups(odd).select("doc_id", "class_id", "links").collect()
    order = lambda rows: sorted(tuple(-1 if v is None else v for v in r) for r in rows)
    assert order(got) == order(brute_groups(docs)) and jaccard_join.groups(empty).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i or -1 for i in ids) == [-1, 1, 2, 5, 6, 7, 8, 9, 10, 11, 12]  # one word of 7 differs: too much
    assert jaccard_join.keep_one(empty).count() == 0


def test_classes_of_one_id_are_kept_apart_and_classes_without_ids_together(spark):
    other, near = "quite another text of seven words here", LONG.replace("word7 ", "changed ", 1)
    docs = [(1, PROSE), (1, other), (2, other), (None, LONG), (None, near), (None, "alone")]
    kept = jaccard_join.keep_one(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    texts = sorted((r.doc_id or -1, r.text) for r in kept)
    assert texts[2:] == sorted([(1, PROSE), (1, other)]) and len(texts) == 4
    assert {t for _, t in texts[:2]} in ({LONG, "alone"}, {near, "alone"})


def test_kept_rows_keep_columns_of_any_name(spark):
    rows = [(1, PROSE, "d", 7, "r", 1, "o"), (2, PROSE, "e", 8, "s", 2, "p"), (3, "alone", "f", None, "t", 3, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _digest string, _chosen_id bigint, row string, own_id int, root string")
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_prefixes_are_shortened_to_the_target():
    depth = jaccard_join.prefix_length(0.8, 0.999)
    assert 1 - (1 - 0.8 ** depth) ** jaccard_join.TREES >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** jaccard_join.TREES


# ----------------------------------------------------------------------------- secrets
def brute_base(text):
    out = []
    for kind, pattern, flags in ((0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
                                 (1, "AKIA[A-Z0-9]+", 0), (2, "[0-9a-f]+", 0)):
        for m in re.finditer(pattern, text, flags):
            if len(m[2] if kind == 0 else m[0]) >= (12, 18, 16)[kind]:
                out.append((m.start(), kind, m.end()))
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


@needs_data
def test_secret_query_keeps_base_spans(spark, small, tmp_path):
    rows = {r.doc_id: r for r in result(spark, tmp_path, "op4_secret_scan")}
    for i, text in small:
        base = brute_base(text)
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert ",".join(s for s in rows[i].spans.split(",") if not s.startswith("guess")) == base
        assert rows[i].n_assign + rows[i].n_access + rows[i].n_hex == (base.count(":") // 2)


def test_guess_costs_order_values():
    cost = secret_scan.log10_guesses
    assert cost("password") < cost("password1") < cost("kq7!Zp0d")
    assert cost("abcabcabcabc") < cost("abcxyzqrtmnp") and cost("qwertyuiop") < cost("qmzpwoxnei") and cost("2021-03-04") < 6
    assert cost("") == 0 and cost("a" * 5000) < 6 and math.isfinite(cost("Zx9" + "q" * 10000))


def test_secrets_of_odd_rows(odd, empty):
    rows = {r.doc_id: r for r in secret_scan.digests(secret_scan.scan(odd)).collect()}
    assert rows[12].n_assign == 1 and "guess:12:28" in rows[12].spans and rows[2].spans == rows[5].spans == ""
    assert secret_scan.scan(empty).count() == 0 and secret_scan.redact(empty).count() == 0
    clean = secret_scan.redact(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    text = clean.where("doc_id = 12").first()
    assert "Tr0ub" not in text.text and "abcdefghijklmnop" not in text.text and text.n_chars == len(text.text)
    assert clean.where("doc_id = 1").first().text == PROSE and clean.where("doc_id = 2").first().text is None
    hidden = "password: secret: abcdefghijklmnop and a password is easy"
    assert [(k, s) for s, k, _, _ in secret_scan.find(hidden)] == [(3, 10)] or brute_base(hidden) == ""


def test_every_value_in_context_is_costed():
    hide = lambda text: secret_scan.mask(text)
    assert hide('password="Correct1Horse2!Battery$9"; x') == '[SECRET]"; x'  # the fixed span ends before the mark
    for text in ("pwd: zqxjkvbwmhtrplfn", "private_key=QZXJKVWPLMTRBNHG", 'dbPassword="kq$$w0rz!Xy7#"', "dbPwd = kq$$w0rz!Xy7#",
                 "DBPwd = kq$$w0rz!Xy7#", "MYPASSWD: kq$$w0rz!Xy7#", "password: secret: kq$$w0rz!Xy7#"):
        assert [k for _, k, _, _ in secret_scan.find(text)] == [3] and "[SECRET]" in hide(text), text
    for text in ("the password is important here", "spin: kq$$w0rz!Xy7#", "the pin is available", "password: changeme"):
        assert secret_scan.find(text) == [], text
    assert [k for _, k, _, _ in secret_scan.find("token=abcdefghijklmnop9")] == [0]  # nothing beyond the fixed span


def test_phrases_and_values_of_any_script_are_masked_whole():
    for text, left in (('password = "correct horse battery staple zq" end', 'password = "[SECRET]" end'),
                       ('passphrase: "my own long secret phrase here"', 'passphrase: "[SECRET]"'),
                       ("pin = 'vier lange wörter zusammen'.", "pin = '[SECRET]'."),
                       ("password: пароль-очень-секрет, ok", "password: [SECRET], ok"),
                       ('pwd="kq$$w0rz!Xy7# not closed', 'pwd="[SECRET] not closed'),
                       ('pwd="kq$$w0rz!Xy7# not\nclosed"', 'pwd="[SECRET] not\nclosed"'),
                       (f'pwd: "{"zq" * 20}#{"kv!" * 200}"', 'pwd: "[SECRET]"')):
        assert secret_scan.mask(text) == left, text
    for text in ('{"token":"abc","user":"longusername42"}', 'password: "" and then nothing', 'password: "your password"',
                 'pwd = "' + "a quotation that goes on and on " * 20 + '"'):
        assert secret_scan.mask(text) == text, text


def brute_guesses(value):
    """The least cost over all segmentations, by trying every last piece of every prefix."""
    pieces = collections.defaultdict(list)
    for i, j, cost in secret_scan._segments(value):
        pieces[i, j].append(cost + secret_scan.PIECE)

    @functools.cache
    def least(j):
        if not j:
            return 0.0
        options = [least(j - 1) + math.log10(secret_scan._alphabet(value[j - 1]))]
        options += [least(i) + min(pieces[i, j]) for i in range(j) if pieces[i, j]]
        for size in range(1, min(j - 1, secret_scan.REPEAT) + 1):
            copies = 1
            while j >= (copies + 1) * size and value[j - (copies + 1) * size:j - copies * size] == value[j - size:j]:
                copies += 1
            if copies > 1:
                options.append(least(j - (copies - 1) * size) + math.log10(copies) + secret_scan.PIECE)
        return min(options)
    return least(len(value))


def test_guess_costs_equal_brute_force():
    rng = np.random.default_rng(4)
    bits = ["password", "P4ssw0rd", "2021-03-04", "1999", "qwerty", "zxcv", "abc", "abcabc", "!!", "Zq", "7", "ö", " ", "dragon"]
    for _ in range(200):
        value = "".join(rng.choice(bits, rng.integers(0, 7)))
        assert secret_scan.log10_guesses(value) == pytest.approx(brute_guesses(value), abs=1e-9), value


# ----------------------------------------------------------------------------- token shards
def test_encoder_equals_whole_encoding():
    odd = ["a  b\n\n c \t x", "  lead", "trail  ", "it's DON'T  we'll", "naïve é ́b", "ΑΣ ΣΑΣ. Σ", "a\x1cb c", "", "   ",
           "x\r\n y", "日本語 テキスト 1234 5", "İstanbul", "a.b'c--d''e 's", "foo,bar;baz[1]{x}=~`", "ª º ²½ × ÷ a×b", PROSE * 50]
    for path, pieces in ((BYTE, tokens.SPACED), (WORD, tokens.WORDS)):
        coder, plain = tokens.Encoder(path, pieces, keep=8), Tokenizer.from_file(path)
        for _ in range(2):
            for text, ids in zip(odd, coder.many(odd), strict=True):
                assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
        old, tokens.SLICE = tokens.SLICE, 50
        try:
            assert coder.ids(odd[-1]).tolist() == plain.encode(odd[-1], add_special_tokens=False).ids
        finally:
            tokens.SLICE = old


def test_encoder_gives_the_library_few_long_words(monkeypatch):
    from tokenizers import Tokenizer
    rng = np.random.default_rng(3)
    letters = list("aeinorstAEÀéñöÿ")
    for path, pieces, leads in ((BYTE, tokens.SPACED, " \n"), (WORD, tokens.WORDS, [""])):
        coder, plain = tokens.Encoder(path, pieces), Tokenizer.from_file(path)
        runs = sorted({str(rng.choice(list(leads))) + "".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(2000)})
        runs += [leads[0] + mark for mark in ("!", "--", "</", ">", "...")]
        words = []

        class Counted:
            def encode_batch_fast(self, some, inner=coder.runs, **options):
                words.extend(some)
                return inner.encode_batch_fast(some, **options)
        monkeypatch.setattr(coder, "runs", Counted())
        assert coder._learn_runs(runs) == []
        starts = sum(run[0] == "\n" for run in runs)
        assert len(words) <= len(runs) / tokens.JOINED + 1 + starts
        for run in runs:
            assert np.frombuffer(coder.known[run], np.uint32).tolist() == plain.encode(run, add_special_tokens=False).ids


def test_encoder_learns_runs_together():
    runs = ["Hello", "naïve", "don", "ÉTÉ", "--..", "zqxj", "a", "]"]
    for path, pieces, lead in ((BYTE, tokens.SPACED, " "), (BYTE, tokens.SPACED, "\n"), (WORD, tokens.WORDS, "")):
        coder, plain = tokens.Encoder(path, pieces), Tokenizer.from_file(path)
        some = [lead + run for run in runs]
        assert all(map(coder.simple, some)) and coder._learn_runs(some) == []
        for piece in some:
            assert np.frombuffer(coder.known[piece], np.uint32).tolist() == plain.encode(piece, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    phrase = rng.integers(0, 60, 40)
    docs = [np.concatenate([rng.integers(0, 60, rng.integers(0, 30)), phrase, [7] * int(rng.integers(0, 40))]) if k % 3 else
            rng.integers(0, 60, rng.integers(1, 5)) for k in range(60)]
    sizes = np.array([len(d) for d in docs])
    s, n, rules, lengths = token_store.compress(np.concatenate(docs), sizes, 60, 500)
    assert (token_store.expand(s, rules, 60) == np.concatenate(docs)).all() and len(s) < 0.6 * sizes.sum()
    row = {"base": 60, "doc_ids": list(range(60)), "n_tokens": sizes.tolist(), "n_symbols": n.tolist(),
           "symbols": s.astype(np.uint16).tobytes(), "rules": rules.tobytes(), "lengths": lengths.astype(np.uint32).tobytes()}
    shard = token_store.Shard(row)
    assert all((a == b).all() for a, b in zip(shard.documents(), docs, strict=True))
    for k in range(60):
        a, b = sorted(rng.integers(0, sizes[k] + 1, 2))
        assert (shard.ids(k, int(a), int(b)) == docs[k][a:b]).all()


@needs_data
def test_token_query_round_trip(spark, small, tmp_path):
    rows = {r.doc_id: r for r in result(spark, tmp_path, "op5_token_store")}
    plain, at = Tokenizer.from_file(BYTE), 0
    for i, text in sorted(small):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_shards_of_odd_rows(spark, odd, empty, tmp_path):
    path = str(tmp_path / "shards")
    token_store.write(odd, path, BYTE, tokens.SPACED, shard_ids=50)
    got = token_store.read_ids(spark, path).orderBy("start").collect()
    assert len(got) == odd.count() and got[0].doc_id is None
    plain = Tokenizer.from_file(BYTE)
    want = {(i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in [(r[0], r[1]) for r in odd_rows()]}
    assert {(r.doc_id, tuple(r.ids)) for r in got} == want
    wanted = spark.createDataFrame([(5, 1000, 1020), (1, 0, 3), (3, 0, 9)], "doc_id bigint, first bigint, stop bigint")
    for r in token_store.read_ranges(spark, path, wanted).collect():
        assert tuple(r.ids) == next(t for i, t in want if i == r.doc_id)[r.first:r.stop]
    token_store.write(empty, str(tmp_path / "none"), BYTE, tokens.SPACED)
    assert token_store.read_ids(spark, str(tmp_path / "none")).count() == 0


# ----------------------------------------------------------------------------- decontamination
@needs_data
@pytest.mark.parametrize("name", ["op6_decontaminate", "op8_warc"])
def test_query_equals_its_sql(spark, tmp_path, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    plain = lambda rows: sorted(map(repr, rows))
    assert plain(tuple(r[c] for c in columns) for r in result(spark, tmp_path, name)) == plain(want.fetchall())


def test_passages_are_found_with_original_offsets(spark, odd, empty):
    bench = spark.createDataFrame([(1, PROSE), (2, "lazy DOG"), (3, None), (None, "under an old oak tree"), (1, PROSE), (4, "--")],
                                  "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "Oh! The QUICK, brown fox—jumps over the lazy dog while... no"), (2, "a lazy  dog."),
                                  (3, "é lazy dog"), (4, None)], "doc_id bigint, text string")
    for words in (50_000, 10):  # one automaton, or several in turn
        rows = {r.doc_id: r for r in decontaminate.scan(docs, bench, block_words=words).collect()}
        assert rows[1].items == ["2"]
        assert rows[2].n_words == 3 and rows[2].n_hit == 2 and [(s.start, s.end) for s in rows[2].spans] == [(2, 11)]
        assert [(s.start, s.end) for s in rows[3].spans] == [(2, 10)] and rows[4].n_words == 0
    assert decontaminate.scan(odd, bench).count() == odd.count() and decontaminate.scan(empty, bench).count() == 0
    none = decontaminate.scan(odd, bench.limit(0)).collect()
    assert all(r.n_hit == 0 for r in none)
    kept = decontaminate.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns and not {1, 4, 7} & {r.doc_id for r in kept.collect()} and kept.where("doc_id = 5").count() == 1


def brute_scan(text, items):
    """n_words, ids of occurring items and hit ranks, by comparing every window with every place."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
    own, hit, ids = split(text or ""), set(), set()
    for item, body in items:
        parts = split(body or "")
        size = min(len(parts), decontaminate.WINDOW)
        for i in range(len(parts) - size + 1 if size else 0):
            for j in range(len(own) - size + 1):
                if own[j:j + size] == parts[i:i + size]:
                    hit |= set(range(j, j + size))
                    ids.add(item)
    return len(own), sorted(i for i in ids if i is not None), hit


@pytest.mark.parametrize("block_words", [50_000, 200, 40])
def test_benchmark_blocks_equal_brute_force(spark, block_words):
    rng = np.random.default_rng(6)
    draw = lambda n: " ".join(rng.choice(["Aa", "b", "é", "c1"], n))
    items = [(f"q{k}", draw(int(rng.integers(0, 25)))) for k in range(40)] + [(None, draw(12)), ("q0", None), ("q1", "zz")]
    texts = [draw(int(rng.integers(0, 60))) for _ in range(30)]
    texts += [texts[0], texts[0], None, "", *(f"{draw(9)}! {b}... {draw(5)} {c}" for (_, b), (_, c) in zip(items[:20], items[5:25]))]
    docs = [(k if k % 7 else None, t, "x") for k, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    table_ = spark.createDataFrame(docs, "doc_id bigint, text string, digest string")
    blocks = decontaminate.Benchmark(bench, block_words).n
    assert (blocks == 1) if block_words == 50_000 else blocks >= 3
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), len(r.spans))
                              for r in decontaminate.scan(table_, bench, block_words=block_words).collect())
    want, clean = collections.Counter(), collections.Counter()
    for i, t, _ in docs:
        n, ids, hit = brute_scan(t, items)
        want[i, n, len(hit), tuple(ids), sum(k - 1 not in hit for k in hit)] += 1
        clean[i, t] += not hit
    assert got == want
    kept = decontaminate.remove_contaminated(table_, bench, block_words=block_words)
    assert kept.columns == table_.columns and collections.Counter((r.doc_id, r.text) for r in kept.collect()) == +clean


# ----------------------------------------------------------------------------- packing
def check_packing(rows, texts, window=2048):
    plain = Tokenizer.from_file(WORD)
    want = collections.Counter()
    for i, t in texts:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] += len(ids)
    sequences = collections.defaultdict(list)
    got = collections.Counter()
    for r in rows:
        sequences[r.sequence_id].append(r)
        got[r.doc_id] += r.length
        if r.ids is not None:
            assert zlib.crc32(packing.unpack(r.ids).astype("<u4").tobytes()) == r.ids_crc32
    assert got == want
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at & (at - 1) == 0


def test_packing_of_odd_rows(odd, empty):
    for size in (1 << 20, 60):
        rows = packing.pack(odd, WORD, tokens.WORDS, window=64, shard_ids=size).collect()
        check_packing(rows, [(r[0], r[1]) for r in odd_rows()], 64)
    assert packing.pack(empty, WORD, tokens.WORDS).count() == 0


@needs_data
def test_packing_query(spark, small):
    rows = packing.pack(table(spark, DATA, "documents"), WORD, tokens.WORDS).collect()
    check_packing(rows, small)
    plain = Tokenizer.from_file(WORD)
    ids = {i: np.array([*plain.encode(t, add_special_tokens=False).ids, 1]) for i, t in small}
    for r in rows:
        assert (packing.unpack(r.ids) == ids[r.doc_id][r.start:r.start + r.length]).all() and r.doc_tokens == len(ids[r.doc_id])


def test_scores_equal_plain_bm25():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, rng.integers(1, 80)) for _ in range(30)]
    idf = rng.random(50).astype(np.float32) + 0.1
    index = packing.Index(docs, idf, 40.0)

    def weight(t, d):
        tf = int((d == t).sum())
        return idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / 40.0))
    for k in range(30):
        assert np.allclose(index.scores(k), [sum(weight(t, d) for t in set(docs[k].tolist())) for d in docs], rtol=1e-4)


def test_keys_of_packing_follow_the_weights():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint32) for _ in range(40)]
    docs.append(rng.permutation(docs[7]))
    idf = rng.random(300).astype(np.float32) + 0.01
    clock = packing.clocks(300)
    got = packing.near_keys(docs, idf, 90.0, clock)
    for d, keys in zip(docs, got.tolist(), strict=True):
        weight = {t: idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / 90.0)) for t, n in collections.Counter(d.tolist()).items()}
        assert keys == [min(weight, key=lambda t: row[t] / weight[t] ** 2) for row in clock]
    assert (got[7] == got[-1]).all()


def test_windows_are_filled_with_the_best_unused_neighbours():
    rng = np.random.default_rng(3)
    docs = [(i, rng.integers(0, 80, rng.integers(1, 40)).astype(np.uint32)) for i in range(60)]
    idf, mean = rng.random(80).astype(np.float32) + 0.1, 20.0
    windows = packing.Windows(128, 0, False)
    packing.fill(docs, idf, mean, windows)
    windows.finish()
    order = list(dict.fromkeys(r[0] for r in sorted(windows.rows, key=lambda r: (r[5], r[6]))))

    def score(q, d):
        own = collections.Counter(d.tolist())
        return sum(idf[t] * own[t] * 2.2 / (own[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(q.tolist()) if own[t])
    unused, want, room, seed, queue = set(range(60)), [], 128, None, []
    while unused:
        if seed is None or not queue:
            if seed is None:
                seed = min(unused)
                queue = [seed]
            else:
                queue = sorted(unused, key=lambda d: (-score(docs[seed][1], docs[d][1]), d))
        k = queue.pop(0)
        unused.discard(k)
        want.append(k)
        size = len(docs[k][1])
        if size >= room:
            left = (size - room) % 128
            room, seed, queue = 128 - left, k if left else None, []
        else:
            room -= size
    assert order == want


# ----------------------------------------------------------------------------- archives
def test_archives_of_odd_pages(spark, tmp_path):
    big = "é" * 900 + "\r\n\r\nWARC/1.1\r\n" * 3 + "tail " * 300
    pages = [(1, "http://a/b c", big), (2, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", "x" * 2000),
             (6, "u\nv", "x" * 2000), (7, "u", "WARC/1.1"), (7, "u", "other"), (8, "", "\r\n")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).withColumn("size", F.lit("x"))
    for size in (1 << 20, 64):
        path = str(tmp_path / f"w{size}")
        warc.write_archives(warc.chunk_table(df, size), path)
        chunks = warc.read_chunks(spark, path)
        rows = warc.records(chunks).collect()
        assert len(rows) == len(pages) and all(r.verified for r in rows)
        got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in rows)
        keeper = {big: 2, "x" * 2000: 6}
        want = sorted((i or -1, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(),
                       "revisit" if keeper.get(h, i) != i else "response", keeper[h] if keeper.get(h, i) != i else 0) for i, _, h in pages)
        assert got == want
        parts = [r for r in chunks.collect() if r.page_id == 2]
        assert "".join(r.payload for r in sorted(parts, key=lambda r: r.chunk_no)) == big
        assert all("WARC/1.1" not in r.payload for r in parts)
    path = str(tmp_path / "none")
    warc.write_archives(warc.chunk_table(df.limit(0)), path)
    assert warc.records(warc.read_chunks(spark, path)).count() == 0


# ----------------------------------------------------------------------------- language model
@needs_data
def test_language_model_base_is_exact(spark, small, tmp_path):
    rows = {r.doc_id: r for r in result(spark, tmp_path, "op9_lm_score")}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)), None] for i, t in small}
    c = collections.Counter(w for i, ws in split.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in split.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables are not here")
def test_language_model_beats_the_base_on_held_out_texts(spark):
    rows = lm_score.score(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_language_model_is_normalised_and_learns():
    ids = np.tile([0, 1, 2, 3], 3000)
    sizes = np.full(300, 40)
    model = lm_score.Model.start(np.arange(5, dtype=np.uint64), np.array([3000.0] * 4 + [1.0]), 5.0)
    before = model.log_probabilities(ids, sizes).mean()
    for seed in range(3):
        model.train(ids, sizes, rate=0.2, seed=seed)
    assert model.log_probabilities(ids, sizes).mean() > before + 0.3
    total = sum(10 ** model.log_probabilities(np.array([0, 1, k]), np.array([3]))[-1] for k in range(6))
    assert abs(total - 1) < 1e-5


def test_language_model_has_every_frequent_word_with_exact_counts(spark):
    # Each block has many more frequent words of its own than the common word, which still counts in all blocks.
    docs = [(i, " ".join([f"w{i}x{k}" for k in range(5000)] * 5 + ["common"] * 2)) for i in range(8)]
    blocks = lm_score.token_blocks(spark.createDataFrame(docs, "doc_id bigint, text string"), 1000).cache()
    words, counts, total = lm_score.vocabulary(lm_score._counts(blocks))
    learn = [(i, t) for i, t in docs if not lm_score.is_held_out(i)]
    true = collections.Counter(int(h) for _, t in learn for h in lm_score.token_hashes(t))
    assert total == sum(true.values())
    assert dict(zip(words.tolist(), counts.tolist())) == {w: n for w, n in true.items() if n >= lm_score.MIN_COUNT}
    assert len(words) > 4096


def test_both_levels_of_the_language_model_are_normalised_and_learn():
    ids = np.tile(np.arange(30), 600)
    sizes = np.full(600, 30)
    model = lm_score.Model.start(np.arange(30, dtype=np.uint64), np.full(30, 600.0), 5.0, head=4)
    before = model.log_probabilities(ids, sizes).mean()
    for seed in range(3):
        model.train(ids, sizes, rate=0.2, seed=seed)
    assert model.log_probabilities(ids, sizes).mean() > before + 0.3
    for context in ([0, 1], [20, 21], [30, 7]):
        total = sum(10 ** model.log_probabilities(np.array([*context, k]), np.array([3]))[-1] for k in range(31))
        assert abs(total - 1) < 1e-4


def test_pairs_of_frequent_words_are_normalised_from_shared_rows(monkeypatch):
    rng = np.random.default_rng(4)
    model = lm_score.Model.start(np.arange(60, dtype=np.uint64), np.arange(600.0, 0, -10), 5.0, head=20)
    model.train(rng.integers(0, 61, 6000), np.full(200, 30), rate=0.2)
    one, two = (w.reshape(-1) for w in np.meshgrid(np.arange(62), np.arange(62)))
    shared = model._log_totals(one, two)
    model.t *= 2000  # such wide logits would underflow in a product of two rows
    wide = model._log_totals(one, two)
    z = ((model._embedded(one) @ model.c1 + model._embedded(two) @ model.c2) @ model.t.T + model.b).astype(float)
    assert np.allclose(wide, np.log(np.exp(z - z.max(axis=1)[:, None]).sum(axis=1)) + z.max(axis=1), rtol=1e-4, atol=1e-3)
    model.t /= 2000
    monkeypatch.setattr(lm_score, "OFTEN", 0)
    assert np.allclose(shared, model._log_totals(one, two), atol=1e-4)


def test_no_level_of_the_language_model_is_wide():
    rng = np.random.default_rng(5)
    model = lm_score.Model.start(np.arange(20_000, dtype=np.uint64), np.sort(rng.zipf(1.3, 20_000) % 9999 + 5.0), 500.0)
    assert max(len(model.t), np.diff(model.spans).max(), np.diff(model.edges).max()) < 100
    for name in ("t", "s", "u", "v", "i"):
        getattr(model, name)[...] = rng.normal(0, 0.3, getattr(model, name).shape)
    ids = np.concatenate([[7, 19_990], np.arange(20_001)])
    sizes = np.array([len(ids)])
    got = model.log_probabilities(ids, sizes)
    one, two = model.contexts(ids, sizes)
    for at in (2, 3, 10_000, 19_000, 20_001, 20_002):
        q = (model._embedded(one[at:at + 1]) @ model.c1 + model._embedded(two[at:at + 1]) @ model.c2)[0]

        def level(z, own):
            return z[own] - np.log(np.exp(z).sum())
        c, row = model.cls[ids[at]], model.place[ids[at]]
        g = model.group[c]
        span = slice(*model.spans[g:g + 2])
        want = level(model.t @ q + model.b, g) + level(model.s[span] @ q + model.a[span], c - span.start)
        if row < len(model.share):
            k = np.searchsorted(model.edges, row, "right")
            words = slice(*model.edges[k - 1:k + 1])
            want += level(model.u[words] @ (q @ model.o) + model.d[words], row - words.start)
        assert abs(got[at] - want / np.log(10)) < 1e-4


def test_language_model_of_odd_rows(odd, empty):
    rows = lm_score.score(odd, block_tokens=1000).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 6)} == {1} and lm_score.score(empty).count() == 0


# ----------------------------------------------------------------------------- quality
@needs_data
def test_quality_agrees_with_labels(spark, odd, empty):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).withColumnRenamed("quality", "p").join(labels, "doc_id").collect()
    clean, toxic, junk = ([r for r in rows if f(r)] for f in (lambda r: r.quality == 1 and r.toxic == 0,
                                                             lambda r: r.toxic == 1, lambda r: r.quality == 0))
    assert sum(r.keep for r in clean) > 0.98 * len(clean)
    assert sum(r.keep for r in toxic) < 0.1 * len(toxic) and sum(r.keep for r in junk) < 0.1 * len(junk)
    scored = {r.doc_id: r for r in quality.score(odd, model).collect()}
    assert not scored[2].keep and not scored[3].keep and not scored[6].keep
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(odd, model).where("keep").collect()}
    assert quality.score(empty, model).count() == 0 and quality.fit(empty, labels) is None
    assert quality.score(odd, None).where("keep").count() == 0
    assert quality.fit(odd, labels.limit(0)) is not None and quality.fit(odd) is not None


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.3
    accuracy = [0.95, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(4000) < 0.2, -1, np.where(rng.random(4000) < a, truth, ~truth)) for a in accuracy], 1)
    p, right = quality.posterior(votes, 0.4, [(0.75, 4.0)] * 4)
    assert ((p > 0.5) == truth).mean() > 0.9 and np.abs(right.mean(axis=1) - accuracy).max() < 0.06


@pytest.mark.parametrize("told", [0.0, 0.5, 1.0])
def test_label_table_gets_the_accuracy_that_it_turns_out_to_have(told):
    rng = np.random.default_rng(9)
    truth = rng.random(12_000) < 0.6
    votes = np.stack([np.where(rng.random(12_000) < 0.9, truth, ~truth) for _ in range(6)]
                     + [np.where(rng.random(12_000) < told, truth, ~truth)], 1).astype(np.int64)
    p, right = quality.posterior(votes, 0.8, [quality.HEURISTIC] * 6 + [quality.TABLE])
    assert ((p > 0.5) == truth).mean() > 0.95 and np.abs(right[-1] - told).max() < 0.03


def brute_posterior(votes, base, trust, rounds=60):
    """One vote at a time, in the textbook's words."""
    known = [[(j, v) for j, v in enumerate(row) if v >= 0] for row in votes]
    p = [(sum(v for _, v in row) + base) / (len(row) + 1) for row in known]
    for _ in range(rounds):
        right = {}
        for j, (accuracy, worth) in enumerate(trust):
            for truth in (0, 1):
                mass = [(q if truth else 1 - q, v) for q, row in zip(p, known) for k, v in row if k == j]
                right[j, truth] = ((sum(m for m, v in mass if v == truth) + accuracy * worth) / (sum(m for m, _ in mass) + worth))
        prior, now = min(0.999, max(0.001, sum(p) / len(p))), []
        for row in known:
            one, zero = prior, 1 - prior
            for j, v in row:
                one *= right[j, 1] if v else 1 - right[j, 1]
                zero *= 1 - right[j, 0] if v else right[j, 0]
            now.append(one / (one + zero))
        moved = max(abs(a - b) for a, b in zip(p, now))
        p = now
        if moved < 1e-6:
            break
    return p


@needs_data
def test_quality_query_against_plain_python(spark, small, tmp_path):
    """The query's scores are those of a plain scorer, whose weak labels come from a plain expectation-maximisation."""
    docs, labels = table(spark, DATA, "documents"), {r.doc_id: r for r in table(spark, DATA, "labels").collect()}
    model = quality.fit(docs, table(spark, DATA, "labels"))
    forms = {i: quality.Form.of(t) for i, t in small if t}
    some = sorted(forms)
    votes = [[*quality.form_votes(forms[i]), labels[i].quality if i in labels and labels[i].quality is not None else -1] for i in some]
    trust = [quality.HEURISTIC] * (len(votes[0]) - 1) + [quality.TABLE]
    assert quality.posterior(np.array(votes), 0.8, trust)[0] == pytest.approx(brute_posterior(votes, 0.8, trust), abs=1e-4)
    rows = {r.doc_id: r for r in result(spark, tmp_path, "op10_quality")}
    assert len(rows) == len(small)
    for i, text in small:
        r = rows[i]
        if not text or not text.strip():
            assert (r.quality, r.toxicity, r.keep) == (0.0, 0.0, False)
            continue
        got = [1 / (1 + math.exp(-(sum(float(w[k]) for k in quality.features(forms[i])) + b)))
               for w, b in (model.form, model.insult)]
        assert (r.quality, r.toxicity) == pytest.approx(got, abs=1e-4)
        assert r.keep == (r.quality >= quality.THRESHOLD and r.toxicity < quality.TOXIC)


# ----------------------------------------------------------------------------- pipeline
@needs_data
def test_pipeline_stage_by_stage_against_row_wise_decisions(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        steps[name] = (before, docs)
        assert name == "lexical_packing" or docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    a, b = steps["quality_classifier"]
    model = quality.fit(a, table(spark, DATA, "labels"))
    scorer = quality.Scorer(model)
    assert ids(b) == sorted(r.doc_id for r in a.collect() if quality._rated(r.text, scorer, quality.THRESHOLD, quality.TOXIC)[2])
    a, b = steps["near_duplicates"]
    assert ids(b) == sorted({c for _, c, _ in brute_groups([(r.doc_id, r.text) for r in a.collect()])})
    a, b = steps["benchmark_decontamination"]
    windows = set().union(*(decontaminate.window_keys(r.text) for r in table(spark, DATA, "benchmark").collect()))
    clean = [r.doc_id for r in a.collect() if not any(w in " " + b" ".join(decontaminate.words(r.text)).decode("latin-1") + " " for w in windows)]
    assert ids(b) == sorted(clean)
    a, b = steps["secret_masking"]
    assert ids(a) == ids(b)
    masked = {r.doc_id: r.text for r in b.collect()}
    assert all(masked[r.doc_id] == secret_scan.mask(r.text) and not secret_scan.ACCESS.search(masked[r.doc_id]) for r in a.collect())
    a, b = steps["lexical_packing"]
    check_packing(b.collect(), [(r.doc_id, r.text) for r in a.collect()])


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            if os.path.isdir(DATA):
                assert stage(spark, docs, DATA).count() <= (docs.count() if name != "lexical_packing" else 10_000)


def test_language_model_takes_one_block_at_a_time(spark, monkeypatch):
    blocks = lm_score.token_blocks(spark.range(40).coalesce(1).selectExpr("id AS doc_id", "concat('a b c ', id) AS text"), 8)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    seen, old = [], spark.conf.get(name)

    def one_block(batches):
        for batch in batches:
            if batch.num_rows > 1:
                raise ValueError("several blocks at once")
            yield batch.select(["block"])
    with rows_at_once(spark, 1):
        assert blocks.coalesce(1).mapInArrow(one_block, "block bigint").count() > 3
    monkeypatch.setattr(lm_score, "rows_at_once", lambda s, rows: seen.append(rows) or rows_at_once(s, rows))
    lm_score.score(spark.range(40).selectExpr("id AS doc_id", "concat('a b c ', id) AS text"), 4, 8).count()
    assert seen == [lm_score.SLICES, 1, 1, lm_score.SLICES] and spark.conf.get(name) == old

"""Spelling variants, chat formatting and the prefix trie against brute force, with odd rows and split conversations."""
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sphereframe.llm import chat, prefix_trie, queries, spelling, turns
from sphereframe.llm.common import stage

CONV = "conv_id bigint, turn bigint, role string, text string, pos bigint, state string, part int, depth string, path string"
DOCS = "doc_id bigint, text string, word string, n string, letters string, form string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ----------------------------------------------------------------------------- spelling
def plain_variants(docs):
    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += len(word) >= 6
    n = {w: c for w, c in counts.items() if c >= 5}
    letters, found = sorted({c for w in n for c in w}), {}
    for w in n:
        near = {w[:i] + w[i + 1:] for i in range(len(w))}
        near |= {w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
        near = [v for v in near if v in n and v != w]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        found[w] = (best if best and n[best] >= 5 * n[w] else None, len(near))

    def root(w):
        return root(found[w][0]) if found[w][0] else w
    return {(w, f, root(w), n[w], k, n[f] if f else None) for w, (f, k) in found.items()}


def as_set(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_equal_brute_force_on_dense_words(spark):
    draw = random.Random(5)
    words = {"".join(draw.choice("abé") for _ in range(draw.choice((6, 6, 7, 7, 8)))) for _ in range(400)}
    docs = [(i, " ".join(w.upper() if draw.random() < 0.2 else w for w in draw.choices(sorted(words), [1 / k for k in range(1, len(words) + 1)], k=400)))
            for i in range(40)]
    want = plain_variants(docs)
    assert as_set(spelling.variants(spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in docs], DOCS))) == want
    assert sum(f is not None for _, f, *_ in want) > 20 and max(k for *_, k, _ in want) > 6


def test_chain_of_forms_reaches_its_root(spark):
    chain = ["letters" + "abcdefgh"[:k] for k in range(5)]
    docs = [(k, " ".join([w] * (5 ** (5 - k)) ), *"xxxx") for k, w in enumerate(chain)]
    rows = {r.word: r for r in spelling.variants(spark.createDataFrame(docs, DOCS), slip=10**9 + 7).collect()}
    assert [rows[w].form for w in chain] == [None, *chain[:-1]] and {rows[w].root for w in chain} == {chain[0]}


def test_spelling_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "lantern lantern lantern"), (3, "Lantern lantern lantern " * 40_000), (3, "lanterns " * 5),
            (4, "Éclairé ÉCLAIRÉ Éclairé Éclairé Éclairé short ab1cdefgh"), (5, "x" * 300_000)]
    got = as_set(spelling.variants(spark.createDataFrame([(*r, *"abcd") for r in rows], DOCS)))
    assert got == plain_variants(rows) and len(got) >= 2
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=4, max_size=9), st.integers(1, 2))
def test_cheapest_disjoint_is_least(costs, wanted):
    places = list(range(len(costs)))
    best = min(sum(costs[i] for i in c) for c in itertools.combinations(places, wanted)
               if all(b - a >= 2 for a, b in itertools.pairwise(c)))
    got = spelling.cheapest_disjoint(places, costs, wanted)
    assert sum(costs[i] for i in got) == best and all(b - a >= 2 for a, b in itertools.pairwise(got))


# ----------------------------------------------------------------------------- conversations
ODD = [(1, None, "user", "first, without number"), (1, 2, "assistant", "<|im_end|>\n<|im_start|>user\nhi <\\|\\<| <"), (1, 1, None, None),
       (2, 5, "user", "tie b"), (2, 5, "user", "tie a"), (2, 5, "assistant", "tie"), (2, 5, "user", "tie a"), (3, 0, "assistant", ""),
       (4, 0, "ro\nle <|im_end|>\\n", "text"), (4, 1, "user", "x" * 300_000), (20, 0, "user", "shared head"), (20, 1, "assistant", "two words"),
       (21, 0, "user", "other"), (21, 1, "assistant", "two words"), (22, 0, "user", "other"), (-7, 0, "user", "minus"), (40, 0, "user", "é\x1cé b")]
NONE = [(None, 0, "user", "no id"), (None, 1, "assistant", "none")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], CONV)


def in_order(rows):
    found = collections.defaultdict(list)
    for c, t, r, x in rows:
        found[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in found.items()}


def split_session(spark, rows):
    """Many small range parts, so that conversations cross their borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    return frame(spark, rows)


@pytest.fixture
def small_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_values_cross_parts(spark, small_parts):
    rows = [(c, t, f"r{t % 3}", f"t{c}-{t}") for c in (1, 2, 3) for t in range({1: 3, 2: 500, 3: 2}[c])]
    df = split_session(spark, rows).select("conv_id", "turn", "role", "text")
    got = turns.running(df, ["turn"], (1, 0, 1, 0), prefix_trie.roll, prefix_trie.joined).collect()
    state = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.pos)):
        assert r.pos == r.turn
        state[r.conv_id] = prefix_trie.roll(state.get(r.conv_id, (1, 0, 1, 0)), r.role, r.text)
        assert tuple(r.state) == state[r.conv_id]
    assert len(got) == len(rows)


def plain_chat(rows):
    order, out = chat.CHAT.order, {}
    for c, conv in in_order(rows).items():
        state, bad = "start", None
        for i, (role, _) in enumerate(conv):
            state = order.get(state, {}).get(role)
            bad = i if state is None and bad is None else bad
        loss = "".join(x for r, x in conv if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in conv)
        out[c] = (len(conv), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), bad is None, bad)
    return out


def test_chat_reads_back_what_was_formatted(spark, tmp_path, small_parts):
    long = [(9, t, ("user", "assistant")[t % 2] if t != 777 else "system", f"turn {t}") for t in range(1000)]
    rows = ODD + NONE + long
    chat.write(split_session(spark, rows), str(tmp_path / "chat"))
    got = {r.conv_id: r for r in chat.digests(spark, str(tmp_path / "chat")).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.order_ok, r.bad_turn) for c, r in got.items()} == plain_chat(rows)
    assert got[9].bad_turn == 777
    pieces = spark.read.parquet(str(tmp_path / "chat")).orderBy("conv_id", "pos", "segment").collect()
    for c, conv in in_order(rows).items():
        mine = [p for p in pieces if p.conv_id == c]
        text = "".join(p.text for p in mine)
        assert chat.parse(text) == conv and len(text) == got[c].formatted_chars
        assert [chat.CHAT.unescape(p.text) for p in mine if p.loss] == [x for r, x in conv if r == "assistant"]
        assert all("<|" not in p.text for p in mine if p.segment == 1)


def test_chat_empty_and_other_template(spark, tmp_path):
    chat.write(frame(spark, []), str(tmp_path / "empty"))
    assert chat.digests(spark, str(tmp_path / "empty")).count() == 0
    plain = chat.Template(lead="[/", escape="~", open="[/turn ", close="[/end]\n", loss=("user",), start="a", order={"a": {"user": "a"}})
    chat.write(frame(spark, [(1, 0, "user", "[/end] [~/ $1 ~"), (1, 1, "user", "b")]), str(tmp_path / "other"), plain)
    row = chat.digests(spark, str(tmp_path / "other"), plain).first()
    assert row.order_ok and row.loss_chars == 16 and row.n_turns == 2
    for wrong in ({"lead": "<<"}, {"escape": "n"}, {"close": "end"}, {"order": {"start": {"user": "gone"}}}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


@pytest.mark.parametrize("name", ["op11_spelling", "op12_chat", "op13_prefix_trie"])
def test_registered_queries_equal_their_sql(spark, name):
    import duckdb
    con, data = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, data)
    assert sorted(names) == sorted(got.columns)
    assert collections.Counter(tuple(r[c] for c in names) for r in got.collect()) == collections.Counter(want.fetchall())


# ----------------------------------------------------------------------------- trie
def plain_trie(rows):
    conv = in_order([r for r in rows if r[0] is not None])
    built = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = (abs(c) - abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(conv.get(base, [])[:h] + own[h:])
    members, children, below = collections.defaultdict(list), collections.defaultdict(list), {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    for s in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        below[s] = (sum(below[k][0] for k in children[s]) or 1, sum(below[k][1] for k in children[s]) + (len(members[s]) - 1) * words)
    out = collections.Counter()
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(s))))
        out[(min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), *below[s], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def trie_rows(df):
    return collections.Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                               for r in prefix_trie.nodes(df).collect())


def test_trie_odd_rows(spark):
    assert trie_rows(frame(spark, ODD + NONE)) == plain_trie(ODD + NONE)
    assert trie_rows(frame(spark, [])) == trie_rows(frame(spark, NONE)) == collections.Counter()


def test_trie_with_spines_over_many_shards(spark, small_parts):
    draw, rows = random.Random(3), []
    for c in range(300):
        turns_ = [] if c % 5 == 4 else [("user", "very common start")]
        turns_ += [(draw.choice(("user", "assistant")), draw.choice(("a", "b c", "d e f"))) for _ in range(draw.choice((0, 1, 2, 3, 4)))]
        if c % 3 == 0:
            turns_ = [("user", "copy one two"), ("assistant", "copy")] * 3
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns_)]
    rows += [(1000, t, "user", f"long {t}") for t in range(700)] + [(1020, t, "user", f"long {t}") for t in range(650)]
    assert trie_rows(split_session(spark, rows)) == plain_trie(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 1500), st.floats(0.05, 0.95))
def test_parentheses_delimit_subtrees(seed, n, deeper):
    draw, depths = random.Random(seed), [0]
    while len(depths) < n:
        depths.append(depths[-1] + 1 if draw.random() < deeper else draw.randint(1, depths[-1] + 1))
    end, leaves = prefix_trie.Parentheses(np.array(depths)).subtrees()
    for i in range(0, n, max(1, n // 50)):
        after = next((j for j in range(i + 1, n) if depths[j] <= depths[i]), n)
        assert end[i] == after
        assert leaves[i] == sum(j + 1 == n or depths[j + 1] <= depths[j] for j in range(i, after))


def test_paths_keep_only_shared_nodes_and_one_more(spark):
    rows = [(c, t, "user", f"{c if t else 'same'} {t}") for c in (20, 40) for t in range(200)]
    ids, built = prefix_trie.rebuilt(frame(spark, rows))
    routes = prefix_trie.paths(ids, stage(prefix_trie.steps(built), "t")).select("length", F.size("path").alias("k")).collect()
    assert [(r["length"], r.k) for r in routes] == [(200, 2), (200, 2)]

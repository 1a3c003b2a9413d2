"""Each operator against a brute-force version, and on nulls, empty and long texts, repeated rows and empty tables."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relscope.llm import ann, bpe, quality_classifier, queries
from relscope.llm.chat_format import format_chats, read_loss, read_turns
from relscope.llm.ngram_join import near_duplicates
from relscope.llm.packing import pack
from relscope.llm.quality_rules import NAMES, judge
from relscope.llm.sharding import shard
from relscope.llm.substring_dedup import dedup_substrings
from relscope.llm.token_counts import UnigramModel, count_tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", " \n\t", "a", "a b c", "Ünïcödé ñ 文字  \x1c x", "x " * 3000, "<|endoftext|> it's\r\n\r\n we'll  go", "z" * 5000]


def docs(spark, texts, first=0):
    """Documents with extra columns whose names operators use inside."""
    rows = [(first + i, t, i, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key int, kind string, bucket int")


def corpus(seed=3, n=60):
    """Random texts with exact copies, near copies and shared passages."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    passage = text(60)
    out = [text(r.randint(0, 120)) for _ in range(n)]
    for i in range(n // 3):
        a = list(r.choice(out))
        kind = r.randrange(3)
        if kind == 1 and a:
            a[r.randrange(len(a))] = "new"
        if kind == 2:
            a[len(a) // 2 : len(a) // 2] = passage[: r.randint(10, 60)]
        out.append(a)
    return [r.choice([" ", "\n", "  "]).join(x) for x in out] + EDGES


@pytest.fixture(scope="module")
def texts():
    return corpus()


def test_sharding(spark, texts):
    df = docs(spark, texts)
    out = shard(df, "doc_id", [1.0] * 4 + [4.0], grown_weight=1.0).collect()
    assert len(out) == len(texts)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    many = shard(spark.range(4000), "id", [1.0] * 4 + [4.0]).groupBy("shard").count().collect()
    assert abs({r.shard: r["count"] for r in many}[4] - 2000) < 200
    repeated = shard(spark.createDataFrame([(None,), (None,), (1,), (1,)], "id long"), "id", [1.0] * 3).collect()
    assert len({(r.shard, r.slot) for r in repeated}) == 4
    assert shard(df.limit(0), "doc_id", [1.0]).count() == 0

    def score(key, s, w):
        h = int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16)
        return w / -np.log((h + 0.5) / 2.0**52)

    for r in out:
        assert r.shard == max(range(5), key=lambda s: score(r.doc_id, s, [1, 1, 1, 1, 4][s]))


def brute_dedup(rows, w):
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - w + 1):
            first.setdefault(tuple(words[d][i : i + w]), d)
    out = {}
    for d, x in words.items():
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if first[tuple(x[i : i + w])] < d:
                gone[i : i + w] = [True] * w
        out[d] = (len(x), sum(gone), " ".join(a for a, g in zip(x, gone) if not g))
    return out


@pytest.mark.parametrize("window", [13, 6])
def test_substring_dedup(spark, texts, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in dedup_substrings(docs(spark, texts, -20), window=window).collect()}
    want = brute_dedup([(i - 20, t) for i, t in enumerate(texts)], window)
    assert got == want and sum(v[1] for v in want.values()) > 100


def test_substring_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long), (1, long), (None, long), (3, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in dedup_substrings(df).where("doc_id IS NULL").collect()] == [0]
    assert sorted((r.doc_id, r.n_removed) for r in dedup_substrings(df).where("doc_id IS NOT NULL").collect()) == [(1, 0), (1, 0), (3, 200)]
    assert dedup_substrings(df.limit(0)).count() == 0


def brute_near(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("shingle,percent,block", [(4, 85, 256), (2, 40, 4)])
def test_near_duplicates(spark, texts, shingle, percent, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs(spark, texts, -9), shingle=shingle, percent=percent, block=block).collect()}
    assert got == brute_near([(i - 9, t) for i, t in enumerate(texts)], shingle, percent)
    assert any(c != d for d, (_, c) in got.items())


def test_near_duplicates_edges(spark):
    rows = [(1, "A b c d e"), (1, "A b c d e"), (2, "a b c d e"), (None, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=str) == [(1, 1), (1, 1), (2, 1), (4, 4), (None, None)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_group():
    from relscope.llm.ngram_join import components_of

    r = random.Random(5)
    base = [set(r.sample(range(4000), 60)) for _ in range(25)]
    sets = []
    for _ in range(300):
        s = set(r.choice(base))
        for _ in range(r.randint(0, 9)):
            s.discard(r.choice(sorted(s)))
            s.add(r.randrange(5000))
        sets.append(np.array(sorted(s), np.int64))
    known = [r.randrange(3) if i < 6 else 1000 + i for i in range(300)]
    n = np.array([len(s) for s in sets])
    got = components_of(np.concatenate(sets), np.r_[0, np.cumsum(n)], n, np.array(known), 80, columns=100)
    up = [known.index(k) for k in known]
    for a in range(300):
        for b in range(a):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((up[a], up[b]))
                up = [x if u == y else u for u in up]
    assert got.tolist() == up


def thue_morse(n):
    """Two different texts of n letters on which sums of letters times powers of an odd number agree modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def with_words(t):
    return " ".join(f"w{i}" for i in range(60)) + " " + t


@pytest.mark.parametrize("id_of", ["null", "real"])
def test_missing_and_repeated_ids(spark, id_of):
    """Rows without an id, a real -1, and one id with several texts, against brute force on rows."""
    r = random.Random(8)
    text = lambda k: " ".join(r.choice("abcdefghijkl") + str(r.randrange(40)) for _ in range(k))
    t, u, v = text(100), text(100), text(80)
    missing = None if id_of == "null" else 9
    rows = [(missing, t), (missing, u), (-1, "zz"), (5, t), (5, u + " " + v[:200]), (7, u), (7, v), (7, v), (8, v + " " + t), (missing, "short"), (missing, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in dedup_substrings(df).collect()), key=str)
    assert got == sorted(((d, *k) for d, k in zip([d for d, _ in rows], brute_dedup_rows(rows, 13))), key=str)
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in near_duplicates(df).collect()), key=str)
    sets = brute_near(list(enumerate(t for _, t in rows)), 5, 80)
    least = lambda c: min((rows[i][0] for i in sets if sets[i][1] == c and rows[i][0] is not None), default=None)
    alone = lambda i: sum(s[1] == sets[i][1] for s in sets.values()) == 1
    assert got == sorted(((rows[i][0], sets[i][0], rows[i][0] if alone(i) else least(sets[i][1])) for i in sets), key=str)


def brute_dedup_rows(rows, w):
    """As brute_dedup, row by row: ids may be missing or repeat."""
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), x in zip(rows, words):
        for i in range(len(x) - w + 1):
            if d is not None:
                k = tuple(x[i : i + w])
                first[k] = min(first.get(k, d), d)
    for (d, _), x in zip(rows, words):
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if d is not None and first[tuple(x[i : i + w])] < d:
                gone[i : i + w] = [True] * w
        yield len(x), sum(gone), " ".join(a for a, g in zip(x, gone) if not g)


def family(r, n, words, change):
    """Texts that each differ from one text in the given number of words."""
    base = [f"b{i}" for i in range(words)]
    out = []
    for k in range(n):
        x = list(base)
        for i in r.sample(range(words), change):
            x[i] = f"e{k}_{i}"
        out.append(" ".join(x))
    return out


def test_near_duplicates_in_large_regions(spark):
    """A family whose texts resemble one another but are not linked, and one that is linked by chains: regions of many
    blocks, cut by pivots and joined block by block."""
    r = random.Random(4)
    apart, linked = family(r, 260, 200, 9), family(r, 260, 200, 3)
    texts = apart + [" ".join("c" + w for w in t.split()) for t in linked] + apart[:40]
    want = brute_near(list(enumerate(texts)), 5, 80)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(docs(spark, texts), block=32, pivots=4).collect()}
    assert got == want and sum(c == i for i, (_, c) in want.items()) > 200


def test_near_duplicates_of_a_very_large_group(spark):
    """More than 20,000 texts in one region. Each has one word of its own, and every seventh five words, of which any
    two are too far from one another, but not from the text without such words."""
    n, words = 20_500, 60
    w = lambda i: F.when(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(words)) == i, F.concat(F.lit(f"x{i}_"), F.col("id"))).otherwise(F.lit(f"w{i}"))
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.when((F.col("id") % 7 == 0) & (F.pmod(F.xxhash64("id"), F.lit(words // 5)) == i % 12), F.concat(F.lit(f"y{i}_"), F.col("id"))).otherwise(w(i)) for i in range(words))).alias("text"))
    got = near_duplicates(rows, shingle=1, percent=90).groupBy("component_id").count().where("count > 1").collect()
    assert [(x["component_id"], x["count"]) for x in got] == [(1, n - (n + 6) // 7)]


def test_long_words_of_two_letters(spark):
    """Texts on which polynomial hashes collide are different words to every operator."""
    from tokenizers import Tokenizer

    a, b = thue_morse(2048)
    rows = [with_words(a), with_words(b), a, b, a + " " + b, b[:-1] + " x"]
    df = docs(spark, rows)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = queries.tokenizer(name)
        lib = Tokenizer.from_file(path)
        assert {x.doc_id: x.ids for x in bpe.encode(df, path).collect()} == {i: lib.encode(t, add_special_tokens=False).ids for i, t in enumerate(rows)}
        packed = collections.defaultdict(list)
        for x in sorted(pack(df, path).collect(), key=lambda x: x.start):
            packed[x.doc_id] += x.ids
        assert packed == {i: [*lib.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(rows)}
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in dedup_substrings(df, window=2).collect()} == brute_dedup(list(enumerate(rows)), 2)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(df, shingle=1, percent=99).collect()} == brute_near(list(enumerate(rows)), 1, 99)
    lines = {x.doc_id: x.n_dup_lines for x in judge(docs(spark, [f"{a}\n{b}\n{a}", f"{a}\n{b}"])).collect()}
    assert lines == {0: 1, 1: 0}
    path = queries.tokenizer("piece_bpe_32k.model")
    many = {x.doc_id: x.n_tokens for x in count_tokens(docs(spark, [a, b, "#" * 20_000]), path).collect()}
    one = {x.doc_id: x.n_tokens for x in count_tokens(docs(spark, [b, a, "#" * 12]), path).collect()}
    assert (many[0], many[1]) == (one[1], one[0]) and many[2] > 1000


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def library(request):
    from tokenizers import Tokenizer

    return queries.tokenizer(request.param), Tokenizer.from_file(queries.tokenizer(request.param))


def strange(n=400):
    r = random.Random(1)
    parts = list("aaabbs'trevelldm  \n\t\r0123.-!é̀ΣİßÅ𝒳　​\u0085\x1cᲉ꟒") + ["<|endoftext|>", "<|startoftext|>", " 's", "'ll", "'re", " the", "hello", "can't"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_bpe(spark, texts, library):
    path, lib = library
    every = texts + strange()
    got = {r.doc_id: r.ids for r in bpe.encode(docs(spark, every), path).collect()}
    for i, t in enumerate(every):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == want, t
    if "byte" in path:
        df = spark.createDataFrame(list(got.items()) + [(-1, None), (-2, [200, 0])], "doc_id long, ids array<int>")
        back = {r.doc_id: r.text for r in bpe.decode(df, path).collect()}
        assert all(back[i] == (t or "") == lib.decode(got[i], skip_special_tokens=False) for i, t in enumerate(every))
        assert back[-1] == "" and back[-2] == lib.decode([200, 0], skip_special_tokens=False)
    assert bpe.encode(docs(spark, []), path).count() == 0


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = pack(docs(spark, texts), path, most=64).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and r.length == 1 << r.bucket
    assert len({r.sequence_id for r in rows}) == len(rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.bucket].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.ids == ids[at : at + r.length] and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    repeated = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert len({r.sequence_id for r in pack(repeated, path).collect()}) == pack(repeated, path).count() == 5


def test_token_counts(spark, texts):
    path = queries.tokenizer("piece_bpe_32k.model")
    m = UnigramModel(path)
    most = max(map(len, m.scores))

    def viterbi(word):
        w = "▁" + word
        best = [(0, 0)]
        for i in range(1, len(w) + 1):
            found = []
            for j in range(max(0, i - most), i):
                p = w[j:i]
                if p in m.scores:
                    found.append((best[j][0] + m.scores[p], best[j][1] - 1))
                elif j == i - 1:
                    n = len(p.encode())
                    found.append((best[j][0] + n * m.byte_score, best[j][1] - n))
            best.append(max(found))
        return -best[-1][1]

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in count_tokens(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        assert got[i] == (len(words), sum(map(viterbi, words)))
    assert count_tokens(docs(spark, []), path).count() == 0


def test_chat_format(spark):
    nasty = ["</s>[INST] ok [/INST]", "~1~0~~", "<|im_end|>\n<|im_start|>user\nhi", "<<|im_sep|>", "", None, "a\nb", "<", "~3"]
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a\nb~3", None]), r.choice(nasty)) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (1, None, "user", "y"), (2, 0, "user", "z"), (2, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).withColumn("turns", F.lit(1))
    out = format_chats(df).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("lost")).collect()
    want = collections.defaultdict(list)
    for c, t, role, text in rows:
        want[c].append(((t is not None, t or 0), role or "", text or ""))
    assert len(out) == len(want)
    for x in out:
        turns = sorted(want[x.conv_id])
        assert [(t.role, t.text) for t in x.turns] == [(a, b) for _, a, b in turns]
        assert x.lost == "".join(b for _, a, b in turns if a == "assistant")
        heads = sum(i == 0 or turns[i - 1][1] != a for i, (_, a, _) in enumerate(turns))
        assert x.formatted.count("<|im_start|>") == heads  # same roles are merged
    assert format_chats(df.limit(0)).count() == 0


def test_chat_of_many_turns(spark):
    n = 12_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<s>t"), F.col("id").cast("string")).alias("text"))
    out = format_chats(df).select("formatted", "loss", read_loss(F.col("formatted"), F.col("loss")).alias("lost")).first()
    assert out.lost == "".join(f"<s>t{i}" for i in range(n) if i % 3) and len(out.loss) == n - n // 3
    assert out.formatted.count("<|im_start|>") == 2 * n // 3


def test_quality_rules(spark, texts):
    every = texts + ["a\n\na\n b \na\n", " a b c a b c\ta b", "é ü\r\né ü\r\n#<", "word " * 100, " ".join(f"{i:x}" for i in range(400))]
    got = {r.doc_id: r for r in judge(docs(spark, every)).collect()}
    for i, t in enumerate(every):
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        marks = [False] * len(w)
        for k in range(len(w) - 2):
            if grams[tuple(w[k : k + 3])] > 1:
                marks[k : k + 3] = [True] * 3
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(marks))
        assert tuple(got[i][n] for n in NAMES) == want
        assert got[i].base_failed == (len(w) < 50 or 100 * sum(marks) > 50 * len(w))
        assert not (got[i].kept and got[i].base_failed)
    r = random.Random(4)
    noise = " ".join("".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(5)) for _ in range(400))
    half = " ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrst')}{i % 97}" for i in range(2000)) + " go on" * 6000
    plain = " ".join(r.choice(["the", "river", "of", "stones", "ran", "quietly", "past", "every", "house", "and", "garden"]) + r.choice(["", "s", "ed", ","]) for _ in range(300))
    bad = {r_.doc_id: r_ for r_ in judge(docs(spark, [noise, half, plain])).collect()}
    assert not bad[0].kept and not bad[0].base_failed and not bad[1].kept
    assert judge(docs(spark, [])).count() == 0


@pytest.mark.parametrize("size,tail", [(8192, 4000), (8192, 4095), (3000, 1100), (700, 300)])
def test_quality_rules_at_the_end_of_a_text(spark, size, tail):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = " ".join(r.text for r in judge(d).where("kept").join(d, "doc_id").where("lang = 'en'").orderBy("doc_id").limit(60).collect())
    good = [plain[i : i + size] for i in range(0, 5 * size, size)]
    r = random.Random(1)
    noise = base64.b64encode(r.randbytes(tail)).decode()[:tail]
    spam = ("buy cheap pills now " * tail)[:tail]
    rows = judge(docs(spark, good + [g + spam for g in good] + [g + noise for g in good])).collect()
    kept = {x.doc_id for x in rows if x.kept}
    assert kept == set(range(len(good)))


def test_kept_against_brute_force(spark, texts):
    import zstandard

    from relscope.llm.quality_rules import BANDS, CHUNKS

    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(900)]
    prose = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    noise = lambda k: base64.b64encode(r.randbytes(k)).decode()
    every = texts + [prose(k) for k in (60, 90, 200, 500, 1500, 4000)] + [prose(400) + " " + noise(k) for k in (100, 900, 5000)] + [prose(600) + " go on" * k for k in (60, 300, 3000)] + [prose(2000)[:n] for n in (511, 512, 2047, 2048, 4095, 8192, 8193)]
    pack = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
    ratio = lambda b: len(pack.compress(b)) / len(b) if b else 1.0
    kept = 0
    for x in judge(docs(spark, every)).collect():
        raw = (every[x.doc_id] or "").encode()
        whole = ratio(raw)
        low, high = max((b for b in BANDS if b[0] <= len(raw)), default=(0, 0, float("inf")))[1:]
        good = low <= whole <= high
        chunk = max((c for c in CHUNKS if c[0] <= len(raw)), default=None)
        parts = []
        if chunk:
            size = chunk[1]
            parts = [ratio(raw[i : i + size]) for i in range(0, len(raw) - size + 1, size)] + ([ratio(raw[-size:])] if len(raw) % size else [])
            good = good and all(chunk[2] <= p <= chunk[3] for p in parts)
        assert (x.ratio, x.lowest_chunk, x.highest_chunk) == (whole, min(parts, default=whole), max(parts, default=whole))
        assert x.kept == (good and not x.base_failed)
        kept += x.kept
    assert kept >= 6


def test_classifier_parts_against_brute_force():
    from relscope.llm.quality_classifier import DIM, REACH, ROWS, context_sums, fit, index_vectors, pooled

    rng = np.random.default_rng(2)
    rows, first = rng.integers(0, 40, 300).astype(np.int32), np.array([0, 0, 70, 71, 180, 300])
    index = index_vectors()
    want = np.zeros((5, DIM))
    for i in range(5):
        if first[i + 1] > first[i]:
            want[i] = index[rows[first[i] : first[i + 1]]].mean(axis=0)
    assert np.allclose(pooled(index, rows, first, block=37), want, atol=1e-5)
    sums, counts = np.zeros((ROWS, DIM), np.float32), np.zeros(ROWS, np.int64)
    context_sums(rows, first, index, sums, counts)
    slow, n = np.zeros((ROWS, DIM)), np.zeros(ROWS)
    for i in range(5):
        text = rows[first[i] : first[i + 1]]
        for a in range(len(text)):
            for b in range(max(0, a - REACH), min(len(text), a + REACH + 1)):
                if a != b:
                    slow[text[a]] += index[text[b]]
                    n[text[a]] += 1
    assert np.allclose(sums, slow, atol=1e-3) and (counts == n).all()
    x = rng.standard_normal((600, 6)).astype(np.float32)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.8 * rng.standard_normal(600) > 0.3).astype(float)
    net = fit(x, y)
    assert np.mean((net.scores(x) >= 0.5) == y) > 0.8
    held = np.random.default_rng(1).permutation(600)[:120]
    loss = lambda t: float(np.mean(-np.log(np.clip(np.where(y[held] > 0, 1 / (1 + np.exp(-net.logits(x[held]) / t)), 1 / (1 + np.exp(net.logits(x[held]) / t))), 1e-12, 1))))
    assert all(loss(net.temperature) <= loss(t) + 1e-6 for t in np.exp(np.linspace(-1.5, 2.5, 81)))


def test_classifier_on_repeated_labelled_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    good, bad = "the river ran past the old mill, and quietly the town went on", "zz zz zz 4$ %% zz zz"
    rows = [(i, good if i % 2 else bad) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:9] * 40, "doc_id long, text string")
    one = {r.doc_id: r.score for r in quality_classifier.score(spark.createDataFrame(rows, df.schema), labels).collect()}
    many = {r.doc_id: r.score for r in quality_classifier.score(df, labels).collect()}
    assert one == pytest.approx(many) and (one[1] > 0.5) != (one[2] > 0.5)


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op7_quality_classifier(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    again = quality_classifier.score(docs(spark, EDGES), labels.where("doc_id < 9"))
    assert again.count() == len(EDGES)
    assert {r.score for r in quality_classifier.score(docs(spark, EDGES), labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score(docs(spark, []), labels).count() == 0
    for r in out.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 48)).astype(np.float32) + rng.standard_normal(48).astype(np.float32) * 2
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, x[0].tolist()), (5020, x[0].tolist()), (5040, None), (5060, [0.0] * 48), (5080, [float("nan")] * 48), (5100, [1.0] * 3), (5120, [None] + [1.0] * 47), (None, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=20, block_rows=700, query_rows=50).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids = np.r_[np.arange(3000), 5000, 5020]
    every = np.vstack([x, x[:1], x[:1]]).astype(np.float64)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        score = (every * every[ids == q]).sum(axis=1)
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(s == score[ids == v][0] for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) > 0.97
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0, k=20).collect()
    assert len(few) == 4


def test_recall_on_the_embeddings_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in df.collect()}
    ids, x = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)], np.float64)
    got = collections.defaultdict(set)
    for r in queries.op9_ann(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in ids[ids % 20 == 0].tolist():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.argsort(-score)[:20]].tolist()))
    assert hits >= 0.98 * 20 * (ids % 20 == 0).sum()


def test_scores_of_double_vectors(spark):
    x = np.random.default_rng(3).standard_normal((60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect():
        assert r.score == (x[r.query_id] * x[r.vec_id]).sum()


def test_nearest_neighbours_of_repeated_rows(spark):
    x = np.random.default_rng(1).standard_normal((400, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    find = lambda r: sorted(map(tuple, ann.nearest(spark.createDataFrame(r, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=20, block_rows=1200).collect()))
    got = find(rows * 2 + rows[7:8] * 30)
    assert len(got) == 20 * 20 and [g[:3] for g in got] == [g[:3] for g in find(rows)]


def test_best_rows_over_many_blocks():
    """A query keeps its best rows from block to block, ties by id; blocks are smaller and larger than k."""
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, (1500, 16)).astype(np.float32)
    ids = rng.permutation(1500)
    rot = ann.Rotation(x.mean(axis=0), 4)
    best = ann.Best(ids[:300], x[:300], 20)
    for a, b in ((0, 7), (7, 30), (30, 900), (900, 1500)):
        ann.search_block(rot, best, ann.Codes(rot, ids[a:b], x[a:b], *rot.encode(x[a:b]), 9.0))
    got = list(zip(*(c.tolist() for c in best.rows()), strict=True))
    want = []
    for q, v in zip(ids[:300].tolist(), x[:300].astype(np.float64), strict=True):
        score = (x * v).sum(axis=1)
        score[ids == q] = -np.inf
        want += [(q, int(ids[i]), score[i]) for i in np.lexsort((ids, -score))[:20]]
    assert got == want


def test_queries_are_not_copied_to_each_block(spark):
    """Rows that the search returns to a shuffle follow the queries, not queries x blocks."""
    x = np.random.default_rng(2).standard_normal((2000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, k=20, block_rows=10, query_rows=10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" in plan  # before: explode(sequence(0, blocks - 1))
    assert out.count() == 100 * 20


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{sf}/documents.parquet")
    edge = spark.createDataFrame([(10**6 + i, t, None, None, None) for i, t in enumerate(EDGES)], d.schema)
    docs_ = d.unionByName(edge).withColumn("left", F.lit("clash"))
    sizes = [docs_.count()]
    for name, stage in p.STAGES:
        assert stage(spark, docs_.limit(0), sf).count() == 0
        out = stage(spark, docs_, sf)
        if name != "packing":
            assert tuple(out.columns) == p.COLUMNS
            before = {r.doc_id: r for r in docs_.collect()}
            docs_ = spark.createDataFrame(out.collect(), out.schema)
            after = {r.doc_id: r for r in docs_.collect()}
            assert after.keys() <= before.keys()
            if name == "near_duplicates":
                want = brute_near([(i, r.text) for i, r in before.items()], 5, 80)
                assert after.keys() == {i for i, (_, c) in want.items() if c == i}
            if name == "substring_dedup":
                want = brute_dedup([(i, r.text) for i, r in before.items()], 50)
                assert {i: r.text for i, r in after.items()} == {i: (k if gone else before[i].text) for i, (n, gone, k) in want.items() if n > gone}
                assert all(r.n_chars == len(r.text) for i, r in after.items() if want[i][1])
        sizes.append(out.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2]
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids == set(after)


def test_pipeline_on_rows_without_an_id(spark, sf):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{sf}/documents.parquet")
    both = d.unionByName(d.withColumn("doc_id", F.lit(None).cast("long")))
    kept = p.rules(spark, p.classify(spark, both, sf), sf).collect()
    assert sorted(r.text for r in kept if r.doc_id is None) == sorted(r.text for r in kept if r.doc_id is not None) != []
    a, b, c = (" ".join(f"{x}{i}" for i in range(99)) for x in "abc")
    rows = [(5, a, "en", "x", 1), (6, b, "en", "x", 2), *((None, t, "en", "x", 3) for t in (a, b, c, c))]
    e = spark.createDataFrame(rows, d.schema).repartition(3)
    once = [(5, a), (6, b), (None, c)]
    for stage in (p.near, p.substrings):
        assert sorted(((r.doc_id, r.text) for r in stage(spark, e, sf).collect()), key=str) == sorted(once, key=str)
    high = spark.createDataFrame([(2**63 - 2, *rows[0][1:]), *rows[1:]], d.schema)
    keys = p._keyed(high).collect()
    assert len({r.key for r in keys}) == 6 and all(r.key == r.doc_id for r in keys if r.doc_id is not None)


def test_pipeline_on_repeated_rows(spark, sf):
    import corpus_pipeline as p

    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a, "en", "x", 1)] * 3 + [(2, a + " and more of it", "en", "x", 2)] * 3 + [(3, b, "en", "x", 3)] * 2
    d = spark.createDataFrame(rows, schema).repartition(3)
    assert sorted((r.doc_id, r.text) for r in p.near(spark, d, sf).collect()) == [(1, a), (3, b)]
    assert sorted((r.doc_id, r.text) for r in p.substrings(spark, d, sf).collect()) == [(1, a)] * 3 + [(2, "and more of it")] * 3 + [(3, b)] * 2


def test_pipeline_keeps_texts_without_words(spark, sf):
    import corpus_pipeline as p

    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    rows = [(1, None, "en", "x", None), (2, "", "en", "x", 0), (3, " \n", "en", "x", 2), (4, "a b", "en", "x", 3)]
    assert sorted(map(tuple, p.substrings(spark, spark.createDataFrame(rows, schema), sf).collect())) == rows

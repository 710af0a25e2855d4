"""Text operators against plain-Python versions, on a fixture of odd rows and on the smallest documents table."""

import base64
import bz2
import collections
import contextlib
import gzip
import hashlib
import json
import lzma
import re
import time
import zlib
from urllib.parse import quote, quote_plus, unquote

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import bpe, common, packing, quality, samples, secrets, simhash, toxicity, wordpiece

LONG = "lorem ipsum dolor " * 20_000
ODD = [
    (1, "The cat sat. password=abcdef123456 and more words here", "x"),
    (1, "The cat sat. password=abcdef123456 and more words here", "x"),
    (2, None, None),
    (3, "", "y"),
    (None, "half ½ Ⅷ 一 <|endoftext|> 's'll ''s \n\n  \t x\r\n", "z"),
    (4, LONG, "x"),
    (5, "a" * 3000 + " " + "ab" * 2000 + " \U0001f600\U0001f600", "x"),
    (6, "one two three four five six seven eight nine ten", "x"),
    (7, "One Two three four five six seven eight nine ten", "x"),
    (8, "\n".join(["same line here", "", "same line here", " \t", "other"]), "x"),
    (9, "   ", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    # names of result and helper columns on purpose: they must not matter
    schema = "doc_id long, text string, source string, n_tokens int, kept string, score string, fp string, spans int, row int, sample_id int"
    return spark.createDataFrame([(*r, 7, "k", "s", "f", 3, 4, 5) for r in ODD], schema)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.table(spark, sf, "documents")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_byte_bpe_equals_the_library(spark, odd, docs, empty):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(open(path, "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (odd, docs):
        rows = bpe.encode_decode(df, path, P.PATTERN).collect()
        texts = collections.Counter(r.text or "" for r in df.select("text").collect())
        assert collections.Counter(bytes(r.decoded).decode() for r in rows) == texts
        for r in rows:
            assert np.frombuffer(r.token_ids, "<u4").tolist() == library.encode_ordinary(bytes(r.decoded).decode())
    assert bpe.digests(empty, path, P.PATTERN).count() == 0
    r = bpe.digests(odd.where("doc_id = 2"), path, P.PATTERN).first()
    assert (r.n_tokens, r.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def long_words(size):
    rng = np.random.default_rng(5)
    for letters in ("etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "ab", "\u00e9\u4e00a"):
        yield "".join(rng.choice(list(letters), size))
    yield from ("a" * size, "the" * (size // 3), "xiggins" * (size // 7), "ases" * (size // 4))


@pytest.mark.parametrize("size", [257, 1000, 4001])
def test_long_words_equal_the_libraries(size):
    import tiktoken
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(open(path, "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = list(long_words(size))
    found = bpe.Merges(ranks).encode_pieces([w.encode() for w in some])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [library.encode_ordinary(w) for w in some]
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    merges, _ = bpe.read_tokenizer(open(P.path("byte_bpe_50k.json"), "rb").read())
    found = merges.encode_pieces([w.encode() for w in some])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [other.encode(w, add_special_tokens=False).ids for w in some]


def test_a_word_of_a_megabyte_equals_the_library_in_seconds():
    import tiktoken

    ranks = bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    merges = bpe.Merges(ranks)
    for word in long_words(1_000_000):
        begun = time.process_time()
        found = merges.encode_pieces([word.encode()])[0]
        assert time.process_time() - begun < 30  # four seconds at most on an idle machine
        assert np.frombuffer(found, "<u4").tolist() == library.encode_ordinary(word)


def greedy(word, initial, continuing):
    at = n = 0
    while at < len(word):
        pieces = continuing if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_word_pieces_are_greedy_longest_matches(odd, empty):
    initial, continuing = {b"a", b"ab", b"abcd", b"x", b"t", b"the"}, {b"a", b"b", b"c", b"cd", b"bcx", b"d", b"h", b"e"}
    rng = np.random.default_rng(1)
    some = [bytes(rng.choice(list(b"abcdxthe"), rng.integers(0, 10)).tolist()) for _ in range(4000)]
    found = wordpiece.LinearMatcher(initial, continuing).counts(some)
    assert found.tolist() == [greedy(w, initial, continuing) for w in some]
    rows = wordpiece.token_counts(odd, lambda: (initial, continuing)).collect()
    assert len(rows) == len(ODD)
    want = collections.Counter((i, len(words(t)), sum(greedy(w.encode(), initial, continuing) for w in words(t))) for i, t, _ in ODD)
    assert collections.Counter(map(tuple, rows)) == want
    assert wordpiece.token_counts(empty, lambda: (initial, continuing)).count() == 0


def base_figures(text):
    text, w = text or "", words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_figures(spark, odd, docs, empty):
    model = quality.Model(np.zeros(quality.FAMILIES << quality.BITS, np.float32))
    for df in (odd, docs):
        got = collections.Counter(tuple(r)[:7] for r in quality.judge(df, model).collect())
        assert got == collections.Counter((r.doc_id, *base_figures(r.text)) for r in df.collect())
    assert quality.judge(empty, model).count() == 0


def test_quality_and_toxicity_on_rows_not_trained_on(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    tox = scored.where("held_out").toPandas()
    hit = tox.predicted == tox.toxic
    # toxic words of the other languages are rare in a table of this size
    assert hit[(tox.toxic == 1) & (tox.lang == "en")].mean() > 0.85 and hit[tox.toxic == 1].mean() > 0.7
    assert hit[tox.toxic == 0].mean() > 0.99
    assert tox.held_out.eq([zlib.crc32(str(i).encode()) % 3 == 1 for i in tox.doc_id]).all()
    judged = quality.judge(docs, quality.fit(docs, labels, per_class=(300, 600))).withColumnRenamed("quality", "p")
    good = judged.join(labels, "doc_id").where("not base_failed").toPandas()
    assert (good.kept == (good.quality == 1)).mean() > 0.95


def test_classifiers_without_labels_or_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, none)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows}) == 1
    assert toxicity.score(empty, model).count() == 0
    assert quality.judge(odd, quality.fit(odd, none)).where("kept").count() == 0  # all are short or repeat themselves
    odd_labels = spark.createDataFrame([(1, None, 1), (None, 1, 0), (3, 1, 0), (3, 1, 0), (5, 2, 9)], "doc_id long, quality int, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, odd_labels)).count() == len(ODD)


def all_spans(text):
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, order, pattern, least in (("access", 1, r"AKIA[A-Z0-9]+", 20), ("hex", 2, r"[0-9a-f]+", 24)):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [x[2] for x in sorted(out)]


def test_secrets_base_spans(odd, docs, empty):
    for df in (odd, docs):
        rows = secrets.scan(df).collect()
        got = collections.Counter((r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.spans if s.depth == 0)) for r in rows)
        assert got == collections.Counter((r.doc_id, ",".join(all_spans(r.text or ""))) for r in df.collect())
    assert secrets.scan(empty).count() == 0


SECRET = "password=abcdef123456"


@pytest.mark.parametrize(
    ("text", "covered", "depth"),
    [
        (f"a {quote('my ' + SECRET, safe='')} b", quote(SECRET, safe=""), 1),
        (f"a {base64.b64encode(('hi ' + SECRET).encode()).decode()} b", base64.b64encode(("hi " + SECRET).encode()).decode(), 1),
        (f"a {base64.b64encode(gzip.compress(SECRET.encode(), mtime=0)).decode()}", base64.b64encode(gzip.compress(SECRET.encode(), mtime=0)).decode(), 1),
        ("a " + "".join(f"\\u{ord(c):04x}" for c in SECRET) + " b", "".join(f"\\u{ord(c):04x}" for c in SECRET), 1),
        (f"é {quote(base64.b64encode(SECRET.encode()).decode() + '=', safe='')}", base64.b64encode(SECRET.encode()).decode(), 1),
        ("secret=token:abcdefgh", None, 0),
        ("toKen=abcdefgh paſsword=abcdefgh", None, 0),
    ],
)
def test_secrets_in_layers(text, covered, depth):
    spans = secrets.scan_text(text)
    if covered is None:
        assert spans == []
    else:
        assert [(text[a:b], d) for k, a, b, d in spans if k == "assign"][:1] == [(covered, depth)]
        assert covered not in secrets.redacted(text, "#")


def test_secrets_stop_on_cycles_and_long_runs():
    assert secrets.scan_text("%2525252525252541" * 50) == []
    assert secrets.scan_text("x" * 300_000 + "%zz" + "\\" * 1000) == []
    assert secrets.redacted(f"a {SECRET} {SECRET}", "#") == "a # #"


def test_secrets_encoded_twice_are_found_twice():
    coded = base64.b64encode(SECRET.encode()).decode()
    packed = base64.b64encode(gzip.compress(f"{coded} {coded}".encode(), mtime=0)).decode()
    copies = [quote(SECRET, safe=""), coded, "".join(f"\\u{ord(c):04x}" for c in SECRET), packed]
    for copy in copies:
        text = f"a {copy}\nb {copy}"
        assert [text[a:b] for k, a, b, _ in secrets.scan_text(text) if k == "assign"] == [copy, copy]
    assert secrets.redacted(" ".join(copies), "#") == "# # # #"


@pytest.mark.parametrize(
    ("text", "covered"),
    [
        (r'{"token": "abc\u002Fdefghi"} é', r'token": "abc\u002Fdefghi'),
        ("é password = p%40ssw0rd123 b", None),
        ("é pass%77ord = abcdefgh b", "pass%77ord = abcdefgh"),
        ("é api%5Fkey: abc%2Fdef b api_key: abc%2Fdef", "api%5Fkey: abc%2Fdef"),
        ("secret= token%3Aabcdefgh", "token%3Aabcdefgh"),
        ("5% off, secret : abc%252Fdefgh", "secret : abc%252Fdefgh"),
    ],
)
def test_secrets_with_a_key_before_a_blank(text, covered):
    got = [text[a:b] for k, a, b, _ in secrets.scan_text(text)]
    assert got == [] if covered is None else covered in got
    packed = base64.b64encode(text.encode()).decode()
    assert bool(got) == bool(secrets.scan_text(f"a {packed} b"))


def coded(data):
    return base64.b64encode(data if isinstance(data, bytes) else data.encode()).decode()


NOISE = " ".join(hashlib.sha256(bytes([i])).hexdigest()[:9] for i in range(60))
ZIPPED = gzip.compress(f"{NOISE} {SECRET} {NOISE}".encode(), mtime=0)
PEM = "\n".join(re.findall(".{1,64}", coded(ZIPPED)))


@pytest.mark.parametrize(
    ("text", "covered"),
    [
        *[(f"{p}{coded('hello ' + SECRET)} b", p + coded("hello " + SECRET)) for p in ("/cb/", "key_", "-", "ab-c/")],
        (f"/cb/{coded(ZIPPED)} b", "/cb/" + coded(ZIPPED)),
        (coded(SECRET + "12").rstrip("=") + "A", coded(SECRET + "12").rstrip("=") + "A"),
        (f"a\n{PEM}\nb c", PEM),
        (f"a\n{coded(ZIPPED)[:76]}\r\n  {coded(ZIPPED)[76:]}", f"{coded(ZIPPED)[:76]}\r\n  {coded(ZIPPED)[76:]}".rstrip("=")),
        (json.dumps(PEM), json.dumps(PEM)[1:-1]),
        (coded(b"\xff\xfe\x00 " + SECRET.encode() + b"\x80"), coded(b"\xff\xfe\x00 " + SECRET.encode() + b"\x80")),
        (coded(b"\0user\0" + SECRET.encode()), coded(b"\0user\0" + SECRET.encode())),
        *[(coded(SECRET.encode(c)), coded(SECRET.encode(c))) for c in ("utf-16", "utf-16-be", "utf-32")],
        (quote(ZIPPED, safe="") + " b", None),
        (quote_plus(ZIPPED) + " b", None),
        ("é " + "".join(f"\\x{c:02x}" for c in ZIPPED) + " b", "".join(f"\\x{c:02x}" for c in ZIPPED)),
        (f"a {repr(ZIPPED)} b", None),
    ],
)
def test_secrets_in_odd_base64_and_bytes(text, covered):
    spans = [text[a:b] for k, a, b, _ in secrets.scan_text(text) if k == "assign"]
    assert spans and (covered is None or any(s.rstrip("=") == covered.rstrip("=") for s in spans))


@pytest.mark.parametrize("pack", [lambda d: gzip.compress(d, mtime=0), bz2.compress, lzma.compress])
def test_secrets_in_later_members(pack):
    for first, second in ((b"nothing here", SECRET.encode()), (SECRET[:9].encode(), SECRET[9:].encode())):
        run = coded(pack(first) + pack(second))
        assert [s[0] for s in secrets.scan_text(f"a {run} b")] == ["assign"]
        assert secrets.redacted(f"a {run} b", "#") == "a # b"


def test_secrets_at_the_end_of_long_streams(monkeypatch):
    run = coded(gzip.compress(b"x, " + "é ".encode() * (24 << 20) + SECRET.encode(), mtime=0))
    assert secrets.redacted(f"a {run} b", "#") == "a # b"
    monkeypatch.setattr(secrets, "CHUNK", 1000)
    monkeypatch.setattr(secrets, "MORE", 5000)
    inner = coded(gzip.compress(SECRET.encode() + np.random.default_rng(1).bytes(3000), mtime=0))
    for at in range(0, 1100, 90):  # whole secrets and whole inner runs, wherever a piece might end
        for held in (SECRET, inner):
            run = coded(gzip.compress(("," * at + " " + held + "," * 3000).encode(), mtime=0))
            assert [s[:3] for s in secrets.scan_text(f"a {run} b")] == [("assign", 2, 2 + len(run))]


def backslashes(sign):
    return lambda t: "".join(f"\\{sign}{ord(c):0{2 if sign == 'x' else 4}x}" for c in t)


WRAPS = [
    lambda t: quote(t, safe=""), lambda t: "".join(f"%{ord(c):02x}" for c in t), backslashes("u"), backslashes("x"), coded, lambda t: base64.urlsafe_b64encode(t.encode()).decode(),
    lambda t: coded(gzip.compress(t.encode(), mtime=0)), lambda t: coded(zlib.compress(t.encode())), lambda t: "\n".join(re.findall(".{1,64}", coded(bz2.compress(t.encode())))),
]


def recovered(text, depth=5):
    """All that decoding the text in plain ways gives, level by level."""
    if depth == 0:
        return
    yield text
    inner = {unquote(text), re.sub(r"\\u([0-9a-f]{4})|\\x([0-9a-f]{2})", lambda m: chr(int(m[1] or m[2], 16)), text)} - {text}
    for run in re.findall(r"[A-Za-z0-9+/_\n-]{16,}=*", text):
        with contextlib.suppress(ValueError):
            data = base64.b64decode(run.replace("\n", "").replace("-", "+").replace("_", "/").rstrip("=") + "===")
            for unpack in (bytes, gzip.decompress, zlib.decompress, bz2.decompress):
                with contextlib.suppress(Exception):
                    inner.add(unpack(data).decode("latin-1"))
    for x in inner:
        yield from recovered(x, depth - 1)


def test_planted_secrets_in_random_layers_are_found_wherever_they_are():
    rng = np.random.default_rng(8)
    for _ in range(60):
        secret, run = SECRET, SECRET
        for k in rng.integers(0, len(WRAPS), rng.integers(1, 5)):
            run = WRAPS[k](("note " if rng.random() < 0.5 else "") + run)
        text = f"é one {run} two\n{run}\nthree {run}."
        assert any(secret in x for x in recovered(text, 6))
        spans = secrets.scan_text(text)
        for at in [m.start() for m in re.finditer(re.escape(run), text)]:
            assert any(k == "assign" and a < at + len(run) and b > at for k, a, b, _ in spans), (run, spans)
        left = secrets.redacted(text, "#")
        assert run not in left and not any(secret in x for x in recovered(left, 6))


@pytest.mark.parametrize("text", ["%" + "25" * 400_000 + "41", "%" + "25" * 400_000 + "zz", "\\" + "u005c" * 160_000 + "u0041", "%32%35" * 130_000, ("%25" * 40 + "41 ") * 7000])
def test_nested_escapes_take_linear_time(text):
    begun = time.process_time()
    secrets.scan_text(text)
    assert time.process_time() - begun < 15  # two seconds at most on an idle machine


def test_deep_levels_of_mixed_escapes():
    for levels in (2, 7, 40):
        first = SECRET[0]
        for i in range(levels):
            first = (f"%{ord(first[0]):02x}" if i % 2 else f"\\u{ord(first[0]):04x}") + first[1:]
        text = f"a {first}{SECRET[1:]} b"
        assert [text[a:b] for k, a, b, _ in secrets.scan_text(text) if k == "assign"] == [first + SECRET[1:]]
        packed = coded(text)
        assert secrets.redacted(f"x {packed} y", "#") == "x # y"


def test_redaction_keeps_other_columns(odd):
    rows = secrets.redact(odd, chars_col="n_tokens").collect()
    assert len(rows) == len(ODD) and odd.columns == list(rows[0].asDict())
    first = [r for r in rows if r.doc_id == 1][0]
    assert first.text == "The cat sat. [SECRET] and more words here" and first.n_tokens == len(first.text)


def brute_fingerprint(text):
    import xxhash

    w = words(ascii_lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    groups = list(range(len(prints)))

    def root(i):
        while groups[i] != i:
            i = groups[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                groups[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_simhash_classes(spark, odd, docs, empty):
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        prints = [brute_fingerprint(r.text) for r in rows]
        roots = brute_components(prints)
        least = {}
        for r, k in zip(rows, roots):
            least[k] = min((x for x in (least.get(k), r.doc_id) if x is not None), default=None)
        want = collections.Counter((r.doc_id, p, least[k]) for r, p, k in zip(rows, prints, roots))
        assert collections.Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.classes(df).collect()) == want
    assert simhash.classes(empty).count() == 0
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 8]


def test_one_of_each_keeps_every_class_when_ids_repeat(spark):
    a, b, c = ("red green blue " * 20, "one two three four " * 20, "moon sun star sky sea " * 20)
    rows = [(1, a), (1, b), (2, a), (3, c), (2, c), (2, c), (None, a), (4, None), (4, "")]
    for some in (rows, rows[::-1]):
        kept = simhash.one_of_each(spark.createDataFrame(some, "doc_id long, text string")).collect()
        known = [(r.doc_id, r.text or "") for r in kept if r.doc_id is not None]
        assert sorted(known) == sorted([(1, a), (1, b), (2, c), (4, "")]) and len(kept) == 5


def test_simhash_chains_and_hot_shards(spark):
    rng = np.random.default_rng(2)
    values = set()
    for centre in rng.integers(0, 2**63, 6, dtype=np.uint64).tolist():
        x = centre
        for _ in range(200):  # a chain of one-bit steps: far ends differ in many bits and are one class
            x ^= 1 << int(rng.integers(0, 64))
            values.add(x)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp long")
    want = collections.defaultdict(list)
    for s, k in zip(signed, brute_components(values)):
        want[k].append(s[0])
    for block in (1, 300, simhash.SHARD_ROWS):  # whatever is searched at once
        found = {r.node: r.root for r in simhash.components(simhash.shard_links(df, block=block)).collect()}
        for members in want.values():
            assert {found.get(m, m) for m in members} == {min(members)}


def test_samples_are_bounded_in_rows_and_bytes(spark):
    rows = [(7, f"text number {i} of an id that has many") for i in range(3000)] + [(i, f"other text {i}") for i in range(100, 120)] + [(None, "x"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0), *[(i, i % 2) for i in range(100, 120)]], "doc_id long, toxic int")
    chosen = samples.sample_ids(labels, "toxic", lambda c: F.lit(True), (5, 50))
    sampled = samples.sampled_rows(df, chosen).collect()
    assert len(sampled) == len({r.sample_id for r in sampled}) and collections.Counter(r.y for r in sampled) == {0: 5, 1: 11}
    all_in = samples.sparse_rows(samples.sampled_rows(df, chosen), lambda: toxicity.document_features)
    some = samples.sparse_rows(samples.sampled_rows(df, chosen), lambda: toxicity.document_features, most=2000)
    assert len(all_in[0]) == 16 and 0 < len(some[0]) < 16 and 8 * len(some[2]) <= 2000


def test_packing_is_gapless_and_whole(spark, odd, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = ["<|endoftext|>", "ab <|endoftext|> cd", "<|endoftext|>x", "x<|endoftext|>", "a<|endoftext|>b<|endoftext|>c", "<|endoftext|><|endoftext|>", "<|endoftext|", " <|endoftext|>  y\n<|endoftext|> "]
    special = odd.sparkSession.createDataFrame([(i, t) for i, t in enumerate(special)], "doc_id long, text string")
    for df in (odd, docs, special):
        rows = packing.pack(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
        want = collections.Counter()
        for r in df.collect():
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
            want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
        total = sum(n * c for (_, n, _), c in want.items())
        assert sorted(x for r in rows for x in [r.sequence_id * 2048 + r.offset]) == sorted(np.cumsum([0, *[r.length for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]])[:-1].tolist())
        assert sum(r.length for r in rows) == total and all(r.offset + r.length <= 2048 for r in rows)
        assert max(r.sequence_id for r in rows) == (total - 1) // 2048
        whole = collections.Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in rows if r.length == r.doc_tokens)
        assert all(want[k] >= c for k, c in whole.items())
        stream = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
        ids_of = collections.defaultdict(list)
        for r in df.collect():
            ids_of[r.doc_id].append(np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"))
        starts = []
        for r in stream:  # every piece is a stretch of a text of its id, and the pieces of a document follow each other
            assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in ids_of[r.doc_id])
            starts.append(r.start == 0 or (r.doc_id, r.start) == upto)
            upto = (r.doc_id, r.start + r.length)
        assert all(starts) and sum(r.start == 0 for r in stream) == df.count()
        assert sum(r.start + r.length == r.doc_tokens for r in stream) == df.count()
    assert packing.pack(empty, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_hilbert_neighbours_touch():
    import itertools

    cells = np.array(list(itertools.product(range(8), repeat=3)))
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_shared_folder_is_the_clusters(spark):
    assert common.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert isinstance(T.StructType.fromDDL(packing.PIECES), T.StructType)

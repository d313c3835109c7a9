"""Problems 1, 3, 5, 7, 8 and 10: fixtures against definitions, and the awkward inputs."""

import base64
import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, p1_copies, p3_versions, p5_quality, p7_leaks, p8_encode, p10_residue
from corpusmill.llm.common import fold, words

COMMON = {"the", "a", "of", "and", "in", "to", "le", "la", "de"} | set(p5_quality.FUNCTION_WORDS)
PROSE = "The pump at the north wall failed in the night, and nobody wrote down why the drain of the hall was shut. "

TEXT = PROSE + "In the morning the keeper of the yard found a long crack above the second valve. It took the two of them until noon to reach the tank and to open it by hand. " \
    "Below the roof a small lamp was left on for the men who had to walk home without a map."


def table(spark, texts, start=1, **more):
    """Documents with nulls and columns that clash with names the operators use inside."""
    rows = [(start + k, t, "x", 7, "k") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, canon string, weight int, key string").withColumn("host", F.lit("h"))


def pairs(df, a="first_id", b="doc_id"):
    return {(r[a], r[b]) for r in df.collect()}


def test_words_ignore_case_width_and_invisible():
    assert words("Stra­ße  ＦＵＬＬ​ x́ İı") == words("STRASSE full x́ i̇I")
    assert words("क़िताब") != words("क़ताब") and len(words("हिन्दी में")) == 2 and words("´a ̈") == ["a"]
    assert words(None) == [] and words(" \n\t") == [] and words("—…!") == []


def test_copies(spark):
    texts = ["Alpha beta, gamma!", "alpha  BETA\ngamma", "alpha gamma beta", None, "", " \n", "...", '{"inlet": "1", "outlet": "2"}', "Outlet: 2\nInlet: 1", "Inlet: 2\nOutlet: 1", "inlet=1; outlet=2"]
    d = table(spark, texts).unionByName(spark.createDataFrame([(None, "alpha beta gamma", "x", 7, "k", "h")], "doc_id long, text string, canon string, weight int, key string, host string"))
    assert pairs(p1_copies.repeated(d)) == {(1, 2), (8, 9), (8, 11)}
    got = {r.doc_id: (r.first_id, r.copies) for r in p1_copies.copies(d).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 8: (8, 3), 9: (8, 3), 10: (10, 1), 11: (8, 3)}
    assert p1_copies.repeated(d.limit(0)).count() == 0


def test_copies_split_buckets_and_hot_text(spark):
    """Tiny buckets force every level of the radix; a hot text takes the broadcast path."""
    rng = random.Random(3)
    texts = ["common start " + " ".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["hot one"] * 150 + ["x " * 50_000]
    d = table(spark, texts).repartition(5)
    want, seen = set(), {}
    for k, t in enumerate(texts, 1):
        c = p1_copies.canonical(t)
        if c in seen:
            want.add((seen[c], k))
        seen.setdefault(c, k)
    from corpusmill.llm import common

    old, common.join_unique.__defaults__ = common.join_unique.__defaults__, (20, 4096)
    try:
        assert pairs(p1_copies.repeated(d, rows=5, size=200, first_bytes=1)) == want
    finally:
        common.join_unique.__defaults__ = old


def test_trie_counts():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(500)]
    trie = p1_copies.Trie()
    for k, t in enumerate(texts):
        trie.add(t, 1, k)
    assert {t: (n, f) for t, n, f in trie.items()} == {t: (texts.count(t), texts.index(t)) for t in set(texts)}


def brute_groups(docs, threshold, size=5, least=40):
    sets = {}
    for i, t in docs:
        w = words(t)
        if len(w) >= least:
            sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(find(i), i) for i in sets if find(i) != i}


def test_versions_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(50, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            base = list(base)
            for _ in range(rng.randint(1, 6)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
    texts += [None, "", "too short a text", "long " + " ".join(vocabulary * 3)]
    d = table(spark, texts)
    want = brute_groups(list(enumerate(texts, 1)), 0.5)
    assert len(want) > 20
    got = {(r.root, r.id) for r in p3_versions.groups(d, threshold=0.5).collect()}
    assert got == want
    assert p3_versions.groups(d.limit(0), threshold=0.5).count() == 0


@pytest.mark.parametrize("known", [True, False])
def test_versions_leave_out_no_pair_of_the_threshold(spark, monkeypatch, known):
    """pairs of half of their union, where minima in bands missed one in some 1,700, with and without known frequencies."""
    ks = (654, 1344, 4265, 7434)
    texts = [" ".join(f"a{k}x{j}" for j in range(at, at + 64)) for k in ks for at in (0, 20)]
    # Below the threshold, of unequal sizes, with a beginning that all share, and of shingles that come again.
    texts += [" ".join(f"b{j}" for j in range(at, at + 64)) for at in (0, 21)] + [" ".join(f"c{j}" for j in range(n)) for n in (44, 84, 85)]
    shared = [f"s{j}" for j in range(60)]
    texts += [" ".join(shared + [f"d{k}y{j}" for j in range(30 + k)]) for k in range(12)] + [" ".join(["again"] * n) for n in (50, 90)]
    if not known:
        monkeypatch.setattr(p3_versions, "FREQUENT", 0)
    got = {(r.root, r.id) for r in p3_versions.groups(table(spark, texts), threshold=0.5, block=3).collect()}
    assert got == brute_groups(list(enumerate(texts, 1)), 0.5)
    assert {(2 * k + 1, 2 * k + 2) for k in range(len(ks))} <= got


def test_versions_hash_a_column_at_once(monkeypatch):
    """the CPU of p3_found: its arrays were made text by text, five mixes for each; now some for 2^15 words."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    column = pa.array([None, "", *texts, None, "one two three"])
    calls, mix = [], p3_versions._mix
    monkeypatch.setattr(p3_versions, "_mix", lambda x: calls.append(len(x)) or mix(x))
    known = np.arange(1 << 8).astype(np.uint8)
    for split, least, levels, most in ((None, 5, known[:0], 10), (words, 5, known, 10), (words, 1, known, 400)):
        calls.clear()
        seen = {}
        for at, sizes, members in p3_versions.shingles(column, 5, least, split, levels):
            assert sizes.sum() == len(members) and len(at) == len(sizes)
            for i, s in zip(at.tolist(), np.split(members, np.cumsum(sizes)[:-1])):
                assert s.tolist() == sorted(set(s.tolist())) and i not in seen
                seen[i] = s & np.uint64((1 << p3_versions.HASH) - 1)
                assert not len(levels) or (s >> np.uint64(p3_versions.HASH) == seen[i] >> np.uint64(p3_versions.HASH - 8)).all()
        w = {i: t.split() for i, t in enumerate(column.to_pylist()) if t and len(t.split()) >= least}
        grams = {i: {tuple(v[k : k + 5]) for k in range(max(1, len(v) - 4))} for i, v in w.items()}
        assert {i: len(s) for i, s in seen.items()} == {i: len(g) for i, g in grams.items()}
        # As many different hashes as different runs, so equal runs have equal hashes in all texts.
        assert len(set().union(*(s.tolist() for s in seen.values()))) == len(set().union(*grams.values()))
        assert len(calls) <= most


def test_versions_count_in_as_many_cells_as_shingles(spark, monkeypatch):
    """F1: a table of 2^24 cells filled from 0.2 GB on, and half the shingles of every text went to the buckets; never a count too low."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(4, 7) for _ in range(rng.randint(30, 90))) for _ in range(1500)] + [None, "", "a b"]
    monkeypatch.setattr(p3_versions, "FEW", 1 << 16)
    d = table(spark, texts).repartition(3)
    counts = {}
    for _, sizes, members in p3_versions.shingles(pa.array(texts), 5, 40, None):
        for s in members.tolist():
            counts[s] = counts.get(s, 0) + 1
    shingle = np.array(list(counts), np.uint64)
    want = p3_versions._levels(np.array(list(counts.values())))
    errors = []
    for most in (1 << 27, 1 << 16):
        monkeypatch.setattr(p3_versions, "FREQUENT", most)
        cells, rows = p3_versions.frequent(d, 5, 40)
        assert cells == min(most, 1 << (sum(len(t or "") for t in texts) // 4).bit_length())
        level = p3_versions._table(cells, rows)
        got = level[p3_versions._cell(shingle, cells)]
        by_cell = np.bincount(p3_versions._cell(shingle, cells), list(counts.values()), cells)
        assert (level == p3_versions._levels(by_cell)).all() and (got >= want).all()
        errors.append((got != want).mean())
    assert 0 < errors[0] < 0.5 * errors[1]


def test_versions_of_firsts_shuffle_no_texts(spark, monkeypatch):
    """the ids of copies are sent to the texts, or the texts without them are written once."""
    from corpusmill.llm.common import Durable

    texts = [TEXT, PROSE, TEXT.upper(), None, PROSE, "one: 1\ntwo: 2", "two=2; one=1"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for sent in (p1_copies.SENT, 0):
            monkeypatch.setattr(p1_copies, "SENT", sent)
            got = p1_copies.firsts(table(spark, texts), Durable(spark))
            assert {(r.doc_id, r.text) for r in got.collect()} == {(k, " ".join(words(texts[k - 1]))) for k in (1, 2, 6)}
            assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_versions_compare_no_texts_that_share_a_passage_only(spark, monkeypatch):
    """The disk of p3_found: texts of one rare passage met in its buckets and went on as pairs; those of similar rests still do."""
    texts = []
    for k in range(40):
        quote = [f"q{k % 4}x{j}" for j in range(20)]
        texts.append(" ".join(quote + [f"own{k}y{j}" for j in range(60 + k)]))
    texts += [texts[7] + " and one word more", texts[7] + " and other words again"]
    seen, verify = [], p3_versions._verify

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(p3_versions, "_verify", counted)
    # As in a corpus far larger than the sample that told frequent shingles before.
    monkeypatch.setattr(p3_versions, "SAMPLE_TEXTS", 4, raising=False)
    got = {(r.root, r.id) for r in p3_versions.groups(table(spark, texts), threshold=0.5).collect()}
    assert got == brute_groups(list(enumerate(texts, 1)), 0.5) == {(8, 41), (8, 42)}
    assert sum(seen) == 3


def test_versions_blocks_link_components_of_one_bucket(spark):
    """Chains inside large buckets: blocks of two force the second search."""
    words_ = [f"w{k}" for k in range(600)]
    texts = [" ".join(words_[k * 12 : k * 12 + 120]) for k in range(30)]
    d = table(spark, texts)
    got = {(r.root, r.id) for r in p3_versions.groups(d, threshold=0.5, block=2).collect()}
    assert got == brute_groups(list(enumerate(texts, 1)), 0.5)


def test_quality(spark):
    table_text = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"
    texts = [TEXT, table_text, "kxq vbnm wrtz plk qwx " * 5, None, "", "  ", TEXT.upper(), "\n".join(f"- item {k}" for k in range(30)), "ha" * 400, PROSE * 400, TEXT.replace(" ", "\n")]
    rows = {r.doc_id: r for r in p5_quality.statistics(table(spark, texts), COMMON).collect()}
    assert [rows[k].prose for k in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [True, False, False, None, None, None, True, False, False]
    assert rows[10].prose is False and rows[10].repeat_share > 0.9  # one sentence again and again
    assert rows[1].n_words == len(words(TEXT)) and rows[4].n_words is None
    found = {r.doc_id for r in p5_quality.not_prose(table(spark, texts), COMMON).collect()}
    assert {2, 3, 8, 9} <= found and not found & {1, 4, 5, 6, 7}
    assert p5_quality.not_prose(table(spark, texts).limit(0), COMMON).count() == 0


def test_leaks(spark):
    item = "The retired index was withdrawn in favour of 593 consecutive readings"
    long = words(item)
    schema = "id string, text string"
    surface = spark.createDataFrame([("s1", item), ("s2", None), ("s3", "  "), ("s4", item)], schema)
    application = spark.createDataFrame([("a1", "what now", "no")], "id string, question string, answer string")
    recall = spark.createDataFrame([("r1", "not this prompt at all but it is long enough", "Red-hot Knots!"), (None, "p", "x")], "id string, prompt string, answer string")
    items = p7_leaks.items(surface, application, recall)
    texts = [
        "x " + " ".join(long[:8]).upper() + " y", " ".join(long[:7]) + " else", "so: what,\nnow", "whatnow", "red hot knots", None, "", "not this prompt at all but it is long enough", "z " * 100_000 + " ".join(long[3:]),
    ]
    d = table(spark, texts)
    want = set()
    for k, t in enumerate(texts, 1):
        w = words(t)
        for i, x in (("s1", item), ("s4", item), ("a1", "what now"), ("r1", "Red-hot Knots!")):
            v = words(x)
            n = min(8, len(v))
            grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
            if any(tuple(w[j : j + n]) in grams for j in range(len(w) - n + 1)):
                want.add((k, i))
    assert pairs(p7_leaks.leaks(d, items), "doc_id", "item_id") == want
    assert pairs(p7_leaks.leaks(d, items, chars=60), "doc_id", "item_id") == want  # several automata
    s = [r for r in p7_leaks.leak_spans(d, items).collect() if r.doc_id == 1 and r.item_id == "s1"]
    assert [texts[0][r.start : r.end] for r in s] == [" ".join(long[:8]).upper()]
    assert p7_leaks.leaks(d, items.limit(0)).count() == 0 and p7_leaks.leaks(d.limit(0), items).count() == 0


PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
def test_encoding_is_exact(spark):
    import tiktoken

    e = bpe.Encoder(PATH)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "the", "ing", "'s", "é", "ß", "水", "🌱", "12", "--", "<|endoftext|>", "\xa0", "é", "qzx", "\r\n", "a" * 40]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", "z" * 30_000, "word " * 5000]
    for t in texts:
        ids = e.encode(t)
        assert ids == ref.encode_ordinary(t), repr(t)[:80]
        assert e.decode(ids) == t and e.count(t) == len(ids)
    d = table(spark, [*texts[:200], None, ""])
    got = {r.doc_id: r.ids for r in p8_encode.encode(d).collect()}
    assert got[201] == [] and got[202] == [] and got[1] == ref.encode_ordinary(texts[0])
    back = {r.doc_id: r.text for r in p8_encode.decode(p8_encode.encode(d)).collect()}
    assert all(back[k + 1] == t for k, t in enumerate(texts[:200]))
    assert p8_encode.encode(d.limit(0)).count() == 0


def test_residue(spark):
    cases = {
        "Dear {{ name }}, your order is here and the shop thanks you for it.": "placeholder",
        "Status: ${value}\nRun: [INSERT title HERE]": "placeholder",
        "The manual explains that a name in double braces, such as {{station}}, is replaced.": None,
        "404 – the page was not found.": "error",
        "A title here\nAccess denied. You lack permission. Incident K123": "error",
        "<noscript>Please enable JavaScript to view this page</noscript>": "script",
        "java.lang.IllegalStateException: x\n" + "\n".join(f"  at a.b(C.java:{k})" for k in range(200)): "error",
        "Your content goes here.": "filler",
        PROSE * 5 + "An access denied message is kinder when it names a person. " + PROSE: None,
        PROSE * 500 + " 404": None,
        # Other wordings and languages, and texts that only speak of such things.
        "We could not locate what you were looking for. Please check the address bar and retry.": "error",
        "Pagina non trovata. La risorsa richiesta non esiste o è stata rimossa.": "error",
        "Página não encontrada. Tente novamente mais tarde.": "error",
        "Internal Server Error\nThe server encountered an internal error or misconfiguration and was unable to complete your request.": "error",
        "Error 500: " + "the server was unable to open the page you want and your request failed. Please try again later or contact the owner of the site. " * 4: "error",
        "java.lang.IllegalStateException: the valve is shut\n  at a.b(C.java:1)\ncaused by: java.io.IOException: the drain is open\n  at a.c(C.java:2)": "error",
        "Für diese Seite wird JavaScript benötigt.": "script",
        "Dear <NAME>, thank you for buying <PRODUCT> from us.": "placeholder",
        "Station: XXXX\nOwner: TBD": "placeholder",
        "The maintenance of the pump takes one hour. It is done in spring.": None,
        "Our new archive is closed on Sundays. The reading room has two desks.": None,
        "The script of the play was written by hand in 1902. It has three acts.": None,
        "The error of the gauge was small. We found it in May.": None,
        "The yard held 404 pumps and 12 valves.": None,
    }
    for text, kind in cases.items():
        assert p10_residue.verdict(text) == kind, text[:60]
    filler = "Lorem dolor ipsum amet. Dolor amet lorem ipsum. Amet ipsum dolor lorem."
    plain = "Dolor amet dolor amet. Amet dolor amet dolor."
    d = table(spark, [*cases, filler, plain, None, "", " "])
    got = {r.doc_id: r.kind for r in p10_residue.residue(d, COMMON).collect()}
    want = {k: v for k, v in enumerate(cases.values(), 1) if v} | {len(cases) + 1: "filler", len(cases) + 2: "filler"}
    assert got == want
    assert p10_residue.residue(d.limit(0), COMMON).count() == 0


def test_boilerplate_is_subtracted_alike_by_both_ways(spark):
    notice = "Please enable JavaScript to view this page."
    texts = [f"{notice}\n{PROSE * 3} number {k}" for k in range(12)] + [notice]
    d = table(spark, texts)
    for keys in (1 << 20, 0):
        got = {r.doc_id: r.kind for r in p10_residue.residue(d, COMMON, broadcast_keys=keys).collect()}
        assert got == {13: "script"}


FRAME = "North yard archive of pumps and valves\nAll notes of the keepers since the first winter stand here in order\n" \
    "Open from Monday to Friday between nine and noon except on feast days\nWritten by hand and copied by the hall in the south wing above the long stair"


def test_short_error_under_boilerplate_is_found(spark):
    notice = "The record you wanted was not found. It may have been moved. Please try again later or go back to the start."
    texts = [f"{FRAME}\n{PROSE * 3} number {k}" for k in range(12)] + [f"{FRAME}\n{notice}", FRAME]
    got = {r.doc_id: r.kind for r in p10_residue.residue(table(spark, texts), COMMON).collect()}
    assert got == {13: "error"}
    assert 13 not in {r.doc_id for r in p5_quality.not_prose(table(spark, texts), COMMON).collect()}


def test_recurrent_placeholders_are_found(spark):
    """A template's line is boilerplate by its count; a larger source needs more of a line."""
    texts = [f"station: {{{{ value }}}}\n{PROSE * 3} number {k}" for k in range(15)]
    got = {r.doc_id: r.kind for r in p10_residue.residue(table(spark, texts), COMMON).collect()}
    assert got == {k: "placeholder" for k in range(1, 16)}
    lines = ["shared line\n"] * 12 + [""] * 1500
    few, many = ([f"{x}page {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k, x in enumerate(lines[:n])] for n in (100, 1500))
    assert p10_residue.recurrent_lines(table(spark, few)).count() == 1
    assert p10_residue.recurrent_lines(table(spark, many)).count() == 0


def test_long_errors_and_filler_are_found():
    """Evidence counts by share whatever the length; frames take their source lines with them."""
    verbs = "open read write close parse check fetch store merge split count scale round trim join sort pick drop send load shift mark bind pack seal".split()
    frames = "\n".join(f'  File "/srv/yard/{v}.py", line {k}, in {v}\n    {v}_valve = {v}(pump, drain={k}, wall="{v} north")' for k, v in enumerate(verbs))
    trace = f"Traceback (most recent call last):\n{frames}\nValueError: the drain of the hall is shut"
    chained = "\n\nDuring handling of the above exception, another exception occurred:\n\n".join(trace.replace("hall", v).replace("drain of", f"{v} near") for v in verbs[:6])
    assert p10_residue.verdict(trace) == p10_residue.verdict(chained) == "error"
    assert p10_residue.verdict("Your content goes here. " * 30) == "filler"
    told = TEXT.replace("a long crack", "an error message")
    assert p10_residue.verdict(told) is None and p10_residue.verdict(f"{told}\n{trace}\n{PROSE}") is None
    assert p10_residue.verdict("\n".join(f"#{k} {v} the north pump again" for k, v in enumerate(verbs))) is None


def test_line_keys_mask_codes_and_fold_punctuation(spark):
    same = ["Request 7f3ac2-bd of Node_12: done", "request  91, of node_7 \u2013 DONE!", "Request\u00a0A-17-c of N-4 done", "REQUEST 1,204.5 of x9: \u200bdone"]
    assert len({k for x in same for k in p10_residue.line_keys(fold(x), 5)}) == 1
    assert p10_residue.line_keys("well-known a\nwell known a\n\n 12:30 \nother", 5)[2:4] == [0, 0]
    assert len(set(p10_residue.line_keys("well-known a\nwell known a\nother", 5))) == 2
    assert p10_residue.line_keys("other", 5) != p10_residue.line_keys("other", 6)
    notice = "Please enable JavaScript to view this page."
    heads = [f"Request {k:x}f{k * 7919:x}b of the north yard archive of pumps and valves in order of the first winter and of the hall" for k in range(13)]
    texts = [f"{h}\n{PROSE * 3}" for h in heads[:12]] + [f"{heads[12]}\n{notice}"]
    for keys in (1 << 20, 0):
        assert {r.doc_id: r.kind for r in p10_residue.residue(table(spark, texts), COMMON, broadcast_keys=keys).collect()} == {13: "script"}


def test_phrases_repeated_without_marks_are_no_prose():
    phrase = "click here to read more about our offers today and in the summer "
    assert p5_quality.is_prose(p5_quality.measure(phrase * 100, COMMON)) is False
    assert p5_quality.is_prose(p5_quality.measure("click here to read more about our offers today " * 100, COMMON | {"to", "here", "more", "our"})) is False
    other = " ".join(f"{phrase}{chr(97 + k)}{chr(98 + k)}" for k in range(20))
    assert p5_quality.is_prose(p5_quality.measure(other, COMMON)) is False
    assert p5_quality.is_prose(p5_quality.measure(TEXT, COMMON)) is True and p5_quality.is_prose(p5_quality.measure(f"{TEXT}\n{TEXT}", COMMON)) is True


def test_copies_of_records_meet_plain_words(spark):
    """Equal words are copies whatever stands between them; equal fields join classes of words."""
    texts = ["Inlet: 5\nOutlet: 7", "inlet 5 outlet 7", "Inlet: 5, Outlet: 7", "Outlet: 7\nInlet: 5", "outlet 7 | inlet 5", "Inlet: 7\nOutlet: 5",
             "unlike", "a: b c\nd: e", "a b: c\nd: e", "d: e\na b: c"]
    d = table(spark, texts)
    assert pairs(p1_copies.repeated(d)) == {(1, 2), (1, 3), (1, 4), (1, 5), (8, 9), (8, 10)}
    got = {r.doc_id: (r.first_id, r.copies) for r in p1_copies.copies(d, rows=2, size=20, first_bytes=1).collect()}
    assert got == {**{k: (1, 5) for k in range(1, 6)}, 6: (6, 1), 7: (7, 1), **{k: (8, 3) for k in (8, 9, 10)}}


def test_prose_of_languages_without_listed_words():
    prose = [
        "Pompa przy północnej ścianie zatrzymała się w nocy i nikt nie zapisał, dlaczego odpływ w hali był zamknięty. Rano stróż podwórza znalazł długie pęknięcie nad drugim zaworem. "
        "Do południa dwaj ludzie szli do zbiornika i na koniec otworzyli go ręcznie.",
        "Насос у северной стены остановился ночью, и никто не записал, почему сток в зале был закрыт. Утром сторож двора нашёл длинную трещину над вторым клапаном. До полудня двое шли к баку и в конце открыли его руками.",
        "北墙的水泵在夜里停了，没有人写下为什么大厅的排水管被关上。早上，院子的看守人在第二个阀门上面发现了一条长裂缝。两个人花了很长时间才走到水箱旁边，用手把它打开。",
    ]
    lists = ["kxq vbnm wrtz plk qwx. " * 5, "насос, клапан, бак, стена, сток, зал, труба, кран, " * 3, "pompa, zawór, zbiornik, rura, kran, ściana, hala, odpływ.", "水泵\n阀门\n水箱\n排水管\n大厅\n院子"]
    judge = lambda t: p5_quality.is_prose(p5_quality.measure(t, COMMON))
    assert [judge(t) for t in prose] == [True] * 3 and [judge(t) for t in lists] == [False] * 4

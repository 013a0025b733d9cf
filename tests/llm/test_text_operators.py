import hashlib
import random
import re
import zlib

import pytest

from lineagelake.llm import decontaminate as D
from lineagelake.llm import pii, toxicity
from lineagelake.llm.packing import best_two_fit, pack
from lineagelake.llm.queries import tokenizer_path


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))


# -- toxicity --------------------------------------------------------------------------


def test_toxicity_is_learned(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = words(rng, 60).split()
        if bad:
            text[rng.randrange(60)] = rng.choice(["zzidiotzz", "qqmoronqq"])
        rows.append((i, " ".join(text), i))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, lab).collect()
    assert len(got) == 400 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y" * 300_000), (3, "y")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert all(r.score == 0.5 for r in toxicity.score_toxicity(docs, none).collect())
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 0), (1, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, one).count() == 5


# -- decontamination -------------------------------------------------------------------


def brute(text, items):
    """Windows of 64 characters, 32 apart, whose best alignment is within the budget."""
    t = D.normal(text)
    found = set()
    for item, raw in items:
        x = D.normal(raw)
        if len(x) < D.SHORTEST:
            continue
        last = max(0, len(x) - D.WINDOW)
        for s in sorted({*range(0, last + 1, D.STRIDE), last}):
            p = x[s : s + D.WINDOW]
            row = [0] * (len(t) + 1)
            for i, c in enumerate(p, 1):
                new = [i]
                for j, d in enumerate(t, 1):
                    new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
                row = new
            if min(row) <= min(int(D.EDITS * len(p)), (len(p) - D.Q) // D.Q):
                found.add(item)
    return found


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[i] = rng.choice("xyz")
        elif kind < 0.7:
            out.insert(i, rng.choice("xyz"))
        elif len(out) > 1:
            out.pop(i)
    return "".join(out)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    items = [(k, words(rng, rng.randint(5, 20))) for k in range(6)] + [(6, "too short"), (7, None), (None, words(rng, 20))]
    docs = []
    for k in range(40):
        text = words(rng, 15)
        if k % 2:
            text += " " + edited(rng, items[k % 6][1].upper() if k % 3 else items[k % 6][1], k % 8) + "\n" + words(rng, 5)
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, "ab")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    known = [(i, t) for i, t in items if i is not None and t is not None]
    want = {i: f for i, t in docs if t and (f := brute(t, known))}
    assert {i: {int(x) for x in r.item_ids.split(",")} for i, r in got.items()} == want and len(want) > 8


def test_a_larger_benchmark_takes_passes(spark):
    rng = random.Random(6)
    items = [(k, words(rng, 20)) for k in range(6)] + [(6, "Is it so?")]
    rows = [(k, words(rng, 10) + " " + (items[k % 7][1] if k % 2 else "") + " " + words(rng, 10), k) for k in range(30)]
    rows += rows[:5] + [(None, items[0][1], 0), (50, words(rng, 30_000) + " " + items[1][1], 1)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (
        sorted((str(r.doc_id), r.item_id, sorted(tuple(m) for m in r.found)) for r in D.with_matches(docs, bench, "found", chars).collect())
        for chars in (D.BLOCK, 150)
    )
    assert one == many and sum(bool(m) for _, _, m in one) > 15


def test_decontamination_spans_and_edges(spark):
    item = "The quick brown fox jumps over the lazy dog and runs away into the deep forest."
    doc = "Before.\n\n  The  QUICK brown fox jumps\tover the lazy dog and runs away into the deep forest.  After"
    df = spark.createDataFrame([(1, doc, "x"), (2, "clean", "y")], "doc_id long, text string, matches string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    row = D.contaminated(df, bench).first()
    _, start, end, edits = map(int, row.spans.split(",")[0].split(":"))
    assert D.normal(doc[start:end]) == D.normal(item)[:64] and edits == 0
    assert [r.doc_id for r in D.drop_contaminated(df, bench).collect()] == [2]
    assert D.drop_contaminated(df, bench).columns == df.columns
    assert D.contaminated(df, bench.limit(0)).count() == 0 and D.contaminated(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("edits", [0, 4])
def test_every_excerpt_of_a_window_is_found(edits):
    rng = random.Random(6)
    item = words(rng, 60)
    index = D.Index([(7, item)])
    for start in range(len(item) - 63):
        excerpt = list(item[start : start + 64])
        for i in rng.sample(range(2, 62), edits):
            excerpt[i] = "z"
        before = words(rng, 30) + " "
        got = index.matches(D.normal(before + "Q" + "".join(excerpt) + "Q"))
        assert {i for i, *_ in got} == {7}, start
        assert all(abs(s - len(before) - 1) <= 16 and n <= 4 for _, s, _, n in got)


def test_short_items_match_as_whole_words():
    index = D.Index([(1, "Who wrote Emma?"), (2, "art of war"), (3, "  ")])
    assert index.matches(D.normal("So:  who WROTE\temma? The art of wars, part of war; art of war.")) == [(1, 4, 19, 0), (2, 50, 60, 0)]
    assert index.matches("") == [] and D.Index([]).matches("a" * 100) == []


def test_benchmark_in_several_blocks(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, words(rng, 12)) for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(D.blocks(bench, 300))) > 3
    assert sorted(i for b in D.blocks(bench, 300) for i, _ in b) == list(range(20))


# -- personal data ---------------------------------------------------------------------

CARD = "4539 1488 0343 6467"


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("mail a.b@c-d.org, or x@y", "email:5:16"),
        ("a@b.c_d@e.f", "email:0:5,email:5:11"),
        ("é 10.0.0.255 and 10.0.0.256 1.2.3.4.5", "ip:2:12,ip:28:35"),
        ("ip 00000000001.2.3.4", "ip:3:20"),
        (f"card {CARD}.", "card:5:24"),
        ("card 4539 1488 0343 6468", ""),
        ("+1 (132) 555-1352 now", "phone:0:17"),
        ("+1 555", ""),
        (None, ""),
        ("", ""),
        ("9" * 20_000, ""),
        ("9 " * 20_000, ""),
        ("a" * 50_000 + "@b.cc", "email:0:50005"),
    ],
)
def test_base_entities(spark, text, spans):
    df = spark.createDataFrame([(1, text, "q")], "doc_id long, text string, base string")
    assert pii.digest(df).first().spans == spans


def test_redaction(spark):
    df = spark.createDataFrame([(1, f"x a@b.cc y {CARD} z +1 (132) 555-1352 1.2.3.4", "s"), (2, None, "t"), (3, "plain", None)], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "x [EMAIL] y [CARD] z [PHONE] [IP]", 2: None, 3: "plain"}
    assert pii.redact(df).columns == df.columns and pii.redact(df.limit(0)).count() == 0


def test_patterns_discover_identifiers(spark):
    rng = random.Random(2)
    rows = [(i, f"{words(rng, 4)} please call number +1 (132) 555-{1000 + i} {words(rng, 3)}") for i in range(30)]
    rows.append((100, "so please call number 132-5550-77 then"))
    rows.append((101, "the year 19555077 went"))
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "id:22:33" and got[101] == ""


def test_patterns_discover_tokens_with_at_and_groups_of_digits(spark):
    rng = random.Random(9)
    rows = [(i, f"{words(rng, 4)} please call number +1 (132) 555-{1000 + i} {words(rng, 3)}") for i in range(60)]
    rows += [(200 + i, f"{words(rng, 4)} kindly mail box user{i}@site.org {words(rng, 3)}") for i in range(60)]
    rows += [(100, "so please call number 132 555 077 then"), (101, "so kindly mail box jane@intranet, then"), (102, "so kindly mail box jo7 then"), (103, "jo7 and joe@x and 132 556 077 went")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(df).collect()}
    assert got[100] == "id:22:33" and got[101] == "id:19:32" and got[102] == "id:19:22" and got[103] == ""
    text = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert text[100] == "so please call number [ID] then" and text[101] == "so kindly mail box [ID], then"


def test_patterns_are_followed_to_the_last_hop(spark):
    # Each context holds the six new instances of the one before, and is trusted once they are known.
    rows = []
    for hop in range(6):
        rows += [(f"k{i}", True, [f"L c{hop}"]) for i in range(86)]
        rows += [(f"n{h}-{i}", False, [f"L c{hop}"]) for h in (hop - 1, hop) if h >= 0 for i in range(6)]
    got, _ = pii.discovered(spark.createDataFrame(rows, "inst string, known boolean, patterns array<string>"))
    assert {r.inst for r in got.collect()} == {f"n{hop}-{i}" for hop in range(6) for i in range(6)}


def test_no_context_of_the_test_tables_is_a_pattern(spark):
    # Personal data stands between random words there: of 400 contexts of base entities and
    # more none holds five known entities and nothing else, so nothing can be discovered; the
    # same documents with planted contexts give the identifiers planted in them.
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    graph = pii._candidates(pii.with_base(pii._keyed(docs.na.fill("", ["text"])), contexts=True))
    rows = graph.selectExpr("inst", "known", "explode(patterns) AS p").distinct().collect()
    held, known = {}, {}
    for r in rows:
        held.setdefault(r.p, set()).add(r.inst)
        if r.known:
            known.setdefault(r.p, set()).add(r.inst)
    good = [p for p, x in known.items() if len(x) >= pii.LEAST_KNOWN and len(x) >= pii.LEAST_SHARE * len(held[p])]
    assert len(known) > 200 and not good
    assert pii.digest(docs).where("spans LIKE '%id:%'").count() == 0
    extra = [(10_000 + i, f"some words then client reference zq{i}x@mail.example.org follows") for i in range(40)]
    extra += [(20_000, "some words then client reference KD-77213-X follows"), (20_001, "KD-77213-X alone")]
    got = pii.digest(docs.union(spark.createDataFrame(extra, docs.schema))).where("spans LIKE '%id:%'").collect()
    assert {r.doc_id: r.spans for r in got} == {20_000: "id:33:43", 20_001: "id:0:10"}


def test_personal_data_of_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x a@b.cc", "d", 5, "m"), (1, "x a@b.cc", "d", 5, "m"), (None, "1.2.3.4", "e", 6, "n")], "doc_id long, text string, doc string, h int, more string")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted((r.text, r.doc, r.h, r.more) for r in got.collect()) == sorted([("x [EMAIL]", "d", 5, "m")] * 2 + [("[IP]", "e", 6, "n")])
    assert pii.digest(df).count() == 3 and pii.digest(df.limit(0)).count() == 0


# -- packing ---------------------------------------------------------------------------


def one_by_one(lengths, capacity):
    """Best-two-fit, piece after piece."""
    left, out = sorted(lengths), []
    while left:
        own, gap = [], capacity
        for n in sorted(left, reverse=True):
            if n <= gap:
                own.append(n)
                gap -= n
        for n in own:
            left.remove(n)
        if gap:
            room = gap + min(own)
            best = max(((a + b, -a) for i, a in enumerate(left) for b in left[i + 1 :] if min(own) < a + b <= room), default=None)
            if best:
                own.remove(min_ := min(own))
                left.append(min_)
                a = -best[1]
                for n in (a, best[0] - a):
                    own.append(n)
                    left.remove(n)
                left.sort()
        out.append(sorted(own))
    return out


def test_plan_equals_one_by_one():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.randint(1, 60) for _ in range(rng.randint(1, 60))]
        counts = {n: lengths.count(n) for n in lengths}
        plan = best_two_fit(counts, 64)
        bins = {}
        for n, _, ranks, each, first, _ in plan:
            for k in range(ranks // each):
                bins.setdefault(first + k, []).extend([n] * each)
        assert [sorted(bins[k]) for k in sorted(bins)] == one_by_one(lengths, 64)


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(1, 120)), "x") for i in range(80)] + [(200, None, "x"), (201, "", "y"), (None, "null id", "y"), (5, "again", "z"), (202, "It's 42 <|endoftext|> é", "z")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, offset string"), tokenizer_path(), capacity=200).collect()
    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 200):
            cut = ids[k : k + 200]
            want.append((-1 if i is None else i, k // 200, k, len(cut), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in cut))))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 200
    assert len(by) <= -(-sum(r.length for r in got) // 200) + 1
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_words_are_looked_up_for_their_tokenizer_only(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(1, "It's  42 Äpfel\n\nand\tmore <|endoftext|>"), (2, ""), (3, "The  the THE")]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        got = {r.doc_id: r.ids_crc32 for r in pack(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
        for i, text in rows:
            ids = t.encode(text, add_special_tokens=False).ids + [1]
            assert got[i] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def test_common_words_are_tokenized_once():
    """Rare words and other spellings do not push a common word out of the memory of ids."""
    from lineagelake.llm.packing import _Words

    class Counting:
        def __init__(self, inner, asked):
            self.inner, self.asked = inner, asked

        def __getattr__(self, name):
            return Counting(self.inner.model, self.asked) if name == "model" else getattr(self.inner, name)

        def tokenize(self, part):
            self.asked.append(part)
            return self.inner.tokenize(part)

    w, asked, rng = _Words(tokenizer_path()), [], random.Random(6)
    w.tokenizer = Counting(w.tokenizer, asked)
    w.model = w.tokenizer.model
    w.MOST = 100
    for _ in range(12):
        rare = ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(90)]
        w.encode([" ".join(["common", "Common,", "(COMMON)", *rare])])
    assert asked.count("common") == 1


def test_parts_looked_up_are_the_tokenizers():
    from tokenizers import Tokenizer

    from lineagelake.llm.packing import _Words

    some = [
        "'s", "'S", "'re", "'VE", "'ll", "'L", "'d", "''", "'", "s", "t", "re", "A", "Bc", "É", "ß", "Ÿ", "×", "÷", "ö", "µ", "²", "e\u0301", "\u0301", "Σ", "İ", "K", "中文",
        "😀", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\x00", "\x7f", "<|", "<|endoftext|>", "<|startoftext|>", "<", "|", "0", "12", "٣", "Ⅷ", "-", "...", "_",
    ]
    t, w, rng = Tokenizer.from_file(tokenizer_path()), _Words(tokenizer_path()), random.Random(7)
    assert w.by_word
    for at_once in (5, 60, 10**6):
        w.AT_ONCE = at_once
        texts = ["", "x" * 300, *("".join(rng.choices(some, k=rng.choice([1, 2, 3, 8, 50]))) for _ in range(500))]
        ids, counts = w.encode(texts)
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
    assert w.encode([])[1].tolist() == []


def test_many_numbers_in_one_text(spark):
    """Matches over several chunks of a text stand where a plain loop finds them."""
    rules = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(digits):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return sum(n - 9 * (n > 9) for n in twice) % 10 == 0

    def plain(text):
        out = []
        for i, (kind, rx) in enumerate(rules.items()):
            for m in re.finditer(rx, text):
                d = re.sub("[^0-9]", "", m[0])
                if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                    out.append((m.start(), i, kind, m.end()))
        return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))

    rng = random.Random(1)
    some = lambda: rng.choice([str(rng.randrange(10 ** rng.randrange(1, 17))), "a.b@c.de", f"10.2.33.{rng.randrange(300)}", f"+49 (30) 1234-{rng.randrange(10**6)}", "word é"])
    texts = [" x ".join(some() for _ in range(n)) for n in (0, 1, 5, 511, 512, 513, 1500, 20_000)]
    got = pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.base_sha256 for r in got} == {i: hashlib.sha256(plain(t).encode()).hexdigest() for i, t in enumerate(texts)}

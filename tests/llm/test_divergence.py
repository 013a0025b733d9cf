import re
from collections import Counter, defaultdict

from hypothesis import given
from hypothesis import strategies as st

from lineagelake.llm.divergence import source_divergence, terms_of

SCHEMA = "doc_id long, text string, lang string, source string, term string, part int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def plain(rows, min_docs=3, top=200):
    """All pairs and terms by loops."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source, terms = lang or "", source or "", plain_terms(text or "")
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        own, whole = shares(counts[lang, source]), shares(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        pairs = []
        for other in (s for x, s in groups if x == lang and s != source):
            q = shares(counts[lang, other])
            pairs.append((other, sum((own[t] - q[t]) ** 2 // q[t] for t in kept)))
        terms = [(t, (own[t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def found(spark, rows, **given):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in source_divergence(df, **given).collect())


@given(st.text(max_size=60))
def test_terms(text):
    assert [t.decode() for part in terms_of(text.encode("utf-8", "surrogatepass").decode("utf-8", "ignore").encode()) for t in part] == plain_terms(text)


def test_terms_of_a_very_long_text():
    text = ("Straße" * 50_000 + " x ") * 9 + "abc, " * 400_000
    pieces = list(terms_of(text.encode()))
    assert len(pieces) > 3 and [t.decode() for p in pieces for t in p] == plain_terms(text)


def test_pairs_and_terms_equal_loops(spark):
    """Nulls, empty groups, ties, repeated rows, a source with most of the rows, other scripts."""
    rows = [(i, f"Alpha beta{'' if i % 3 else ' ÉTÉ été'} w{i % 7} tail-{chr(97 + i % 5)}{chr(97 + i % 4)}", "en", "hot") for i in range(60)]
    rows += [(100 + i, f"alpha gamma {'rare ' * i}x_y", "en", f"s{i % 4}") for i in range(12)]
    rows += [(200, None, "en", "null-text"), (201, "", "en", None), (202, "alone alone alone", "fr", "f"), (203, "b", None, "n"), (204, "b b", None, "m"), (205, "B c", None, "n")]
    rows += [(100, "alpha gamma x_y", "en", "s0")] * 3 + [(300, "une fois", "de", "p"), (301, "deux", "de", "q")]
    got = found(spark, rows)
    assert got == plain(rows)
    assert ("de", "p", "pair", "q", 0, 1) in got and any(r[0] == "" for r in got) and not any(r[0] == "fr" and r[2] == "pair" for r in got)
    assert found(spark, rows, min_docs=1, top=2) == plain(rows, 1, 2)


def test_an_empty_table(spark):
    assert found(spark, []) == []

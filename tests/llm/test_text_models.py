"""Line classifier, tokeniser fertility, license scan, BPE and packing."""

import numpy as np
import pytest
import regex
import tiktoken
from conftest_llm import prose
from pyspark.sql import functions as F

from orrery.llm import bpe, crf, fertility, licenses, packing
from orrery.llm._tokens import PATTERN, byte_tokens, file_bytes, piece_tokens, read_ranks


def junk(i):
    return "\n".join(" ".join(w.upper() + "!!" for w in line.split()) for line in prose(i, 60).split("\n")) if i % 2 else "\n".join("aa | bb | cc | dd" for _ in range(8))


@pytest.fixture(scope="module")
def labelled(spark, make):
    rows = [(i, prose(i, 80) if i % 3 else junk(i)) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_crf_holds_out(make, labelled):
    rows, labels = labelled
    got = {r.doc_id: r for r in crf.classify(make(rows), labels).collect()}
    assert all(got[i].accepted == (i % 3 > 0) for i in range(90, 120))


def test_crf_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    f = crf.Field(np.zeros(0), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(0), np.ones(0))
    doc = np.array([0, 0, 0, 0, 1, 2, 2])
    s = rng.normal(size=7)
    got, _, total = crf.marginals(s, f, crf.padded(doc))
    logz = 0.0
    for d in range(3):
        own = np.flatnonzero(doc == d)
        z, p = 0.0, np.zeros(len(own))
        for y in np.ndindex(*[2] * len(own)):
            e = f.first[y[0]] + sum(s[i] * v for i, v in zip(own, y, strict=True)) + sum(f.moves[a, b] for a, b in zip(y, y[1:], strict=False))
            z += np.exp(e)
            p += np.exp(e) * np.array(y)
        assert np.allclose(got[own], p / z)
        logz += np.log(z)
    assert np.isclose(total, logz)


def plain_lines(text):
    """Length and features of every line with a word, character by character."""
    out = []
    symbol = lambda c: c.isascii() and not c.isalnum() and not c.isspace() and c not in ".,;:'\"()-?"
    for line in text.split("\n"):
        words = [w for w in regex.split(r"[ \t\r\x0b\x0c\x1c-\x1f\x00]+", line) if w]
        if not words:
            continue
        n, k = len(line), len(words)
        upper, lower = sum(c.isascii() and c.isupper() for c in line), sum(not c.isascii() or c.islower() for c in line)
        digits, gaps = sum(c.isascii() and c.isdigit() for c in line), sum(c.isascii() and c.isspace() for c in line) + 1
        symbols, stops = sum(map(symbol, line)), sum(c in ".,;:'\"()-?" for c in line)
        rare = 1 - len(set(words)) / k
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        x = [np.log1p(n), np.log1p(k), n / k, upper / max(1, upper + lower), digits / n, symbols / n, stops / n, gaps / n, rare, rare * np.log1p(k), again / k]
        out.append((n, [*x, sum(len(w.encode()) > 20 for w in words) / k, sum(symbol(w[-1]) for w in words) / k, float(symbols > 0)]))
    return out


def plain_quality(text, f):
    """Quality and labels of lines, over all labellings."""
    lines = plain_lines(text)
    z = [(np.array(x) - f.mean) / f.scale for _, x in lines]
    none = np.zeros_like(f.mean)
    n = len(z)
    score = [float(np.concatenate([z[i], z[i - 1] if i else none, z[i + 1] if i + 1 < n else none, [i > 0, i + 1 < n, 1]]) @ f.weights) for i in range(n)]
    total, good = 0.0, np.zeros(n)
    for y in np.ndindex(*[2] * n):
        e = np.exp(f.first[y[0]] + sum(s for s, v in zip(score, y, strict=True) if v) + sum(f.moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += e
        good += e * np.array(y)
    p, size = good / total, np.array([n for n, _ in lines])
    return float(p @ size / size.sum()), (p >= 0.5).tolist()


def test_crf_is_that_of_all_labellings(make, labelled):
    rows, labels = labelled
    clean, bad = "The rain had stopped, and they walked on (at last) to the old house.", "BUY!! BUY!! $$$ 100% *** click@@ AA BB"
    texts = [clean, bad, f"{clean}\n{bad}\n{clean}", f"{bad}\n{bad}\n\n  \n{clean}\n{bad}", f"é ü 日本\t{clean}\n" * 4 + bad, "x " * 40 + "\n" + "a_b#c " * 9, f"\n{clean}\n\x1c\n{clean} {clean}\r\n{bad}{bad}", "Supercalifragilisticexpialidocious 12 12 12\nno"]
    docs = [*rows, *((1000 + i, t) for i, t in enumerate(texts))]
    f = crf.train(make(docs), labels)
    got = {r.doc_id: r for r in crf.classify(make(docs), labels).filter("doc_id >= 1000").collect()}
    for i, t in enumerate(texts):
        q, good = plain_quality(t, f)
        assert np.isclose(got[1000 + i].quality, q, atol=1e-9) and got[1000 + i].good_lines == good and got[1000 + i].accepted == (q >= 0.5)
    assert any(len(set(r.good_lines)) == 2 for r in got.values())


def test_crf_odd_rows(make, odd, labelled, spark):
    rows, labels = labelled
    df = make([*rows, *((None if i is None else 1000 + i, t) for i, t in odd)], clashing=True)
    out = crf.classify(df, labels)
    assert out.count() == df.count()
    blank = {r.doc_id: r for r in out.filter("doc_id in (1002, 1003, 1004)").collect()}
    assert all(r.quality is None and not r.accepted and r.good_lines is None for r in blank.values())
    assert crf.keep_good(df, labels).columns == df.columns
    none = labels.limit(0)
    assert {(r.quality, r.accepted) for r in crf.classify(make([(1, "a b"), (2, "")]), none).collect()} == {(None, True), (None, False)}
    assert crf.classify(make([]), labels).count() == 0


def test_fertility_bands(make):
    rows = [(i, prose(i, 200)) for i in range(80)] + [(100, "zq" * 300), (101, "☃亜あ" * 80 + " \U0001f600" * 90)]
    got = {r.doc_id: r for r in fertility.fertility(make(rows)).collect()}
    sp, is_byte = piece_tokens(file_bytes("piece_bpe_32k.model"))
    ids = sp.encode(rows[5][1])
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert got[5].n_tokens == len(ids) and np.isclose(got[5].chars_per_token, len(rows[5][1]) / len(ids)) and np.isclose(got[5].byte_share, is_byte[ids].mean())
    assert np.isclose(got[5].token_entropy, -(p * np.log2(p)).sum() / np.log2(len(ids)))
    assert got[100].verdict != "keep" and got[101].verdict != "keep"
    assert sum(got[i].verdict == "keep" for i in range(80)) == 80


def plain_verdicts(rows, width=fertility.WIDTH, least=fertility.LEAST):
    """Verdict of each measured row (lang or script key, script, tokens, statistics), by plain lists."""
    size = lambda n: int(np.floor(np.log2(n)))
    some = [r for r in rows if r.n_tokens]
    out = []
    for r in rows:
        if not r.n_tokens:
            out.append("empty")
            continue
        for same in (lambda x: x.band_key == r.band_key, lambda x: x.script == r.script, lambda x: True):
            group = [x for x in some if same(x)]
            if len(group) >= least:
                break
        else:
            out.append("keep")
            continue
        reach = 0
        while len(band := [x for x in group if abs(size(x.n_tokens) - size(r.n_tokens)) <= reach]) < least:
            reach += 1
        why = "keep"
        for name, floor in reversed(fertility.STATS.items()):
            q1, mid, q3 = np.percentile([getattr(x, name) for x in band], [25, 50, 75], method="inverted_cdf")
            if abs(getattr(r, name) - mid) > width * max(q3 - q1, floor):
                why = name
        out.append(why)
    return out


def test_fertility_verdicts_are_those_of_plain_lists(make, spark):
    rng = np.random.default_rng(7)
    rows = [(i, prose(i, int(rng.integers(20, 400))), ("en", "de", "xx")[i % 3] if i < 200 else None) for i in range(220)]
    rows += [(300 + i, "Und " * int(rng.integers(10, 900)), "de") for i in range(9)] + [(320 + i, "☃亜あ" * 40 + prose(i, 20), "en") for i in range(5)]
    rows += [(340, "где это " * 30, "ru"), (341, "", "en"), (342, None, None), (343, "жук " * 3, None), (344, prose(5, 9000), "fr")]
    docs = spark.createDataFrame([(i, t, g, "src", 0) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    measured = sorted(fertility.measured(docs).collect(), key=lambda r: r.doc_id)
    got = [r.verdict for r in sorted(fertility.fertility(docs).collect(), key=lambda r: r.doc_id)]
    want = plain_verdicts(measured)
    assert got == want and len(set(want)) >= 4


def test_fertility_judges_thin_bands(make, spark):
    rows = [(i, prose(i, 200)) for i in range(80)]
    junk = [(100, "For " * 9_000, "en"), (101, "Und " * 200, "xx"), (102, "Und " * 9_000, None)]
    clean = [(200, prose(200, 200), "xx"), (201, prose(201, 200), None)]
    docs = make(rows).unionByName(spark.createDataFrame([(i, t, g, "src", len(t)) for i, t, g in junk + clean], "doc_id long, text string, lang string, source string, n_chars long"))
    got = {r.doc_id: r.verdict for r in fertility.fertility(docs).collect()}
    assert "keep" not in {got[i] for i, _, _ in junk}
    assert {got[i] for i in [*range(80), 200, 201]} == {"keep"}
    assert {r.doc_id for r in fertility.keep_fertile(docs).collect()} == {*range(80), 200, 201}
    assert [fertility.script(x) for x in ("", "!? 1", "abc", "abc где это", "日本語のテキスト", "ทดสอบ")] == ["other", "other", "latin", "cyrillic", "other", "other"]


def test_fertility_band_is_narrow(spark):
    # entropies with an interquartile range of 0.05 about 0.6; a loop of one word lies 0.25 below
    rows = [(i, "en", 5000, 3.0, 0.0, 0.55 + 0.1 * i / 99, "latin") for i in range(100)] + [(100, "en", 5236, 3.0, 0.0, 0.35, "latin")]
    df = spark.createDataFrame(rows, "doc_id long, band_key string, n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string")
    got = {r.doc_id: r.v for r in df.join(fertility.bands(df), fertility.in_band(F.col, F.col)).select("doc_id", fertility.verdict(F.col, F.col).alias("v")).collect()}
    assert got[100] == "token_entropy" and {got[i] for i in range(100)} == {"keep"}


def test_fertility_odd_rows(make, odd, spark):
    df = make(odd, clashing=True)
    got = fertility.fertility(df)
    assert got.count() == len(odd)
    assert {r.doc_id for r in got.filter("verdict = 'empty'").collect()} == {2, 3, None}
    kept = fertility.keep_fertile(df)
    assert kept.columns == df.columns and kept.count() == len(odd) - 3
    assert fertility.fertility(make([])).count() == 0
    nolang = df.drop("lang")
    assert {r.band_key for r in fertility.fertility(nolang).filter("doc_id = 7 or doc_id = 9").collect()} == {"script:latin", "script:other"}


def test_license_scan_is_that_of_the_whole_text(make):
    notice = licenses.NOTICES[0][1]
    texts = [
        prose(1, 50) + " " + notice + ". " + prose(2, 20),
        "Licensd under the Apche License,  Version\n2.0",
        "licensed under the apache licence version 2.0",
        "All rights reserved. all rights\nreserved",
        "Licensed under something else entirely",
        "spdx-license-identifier: mit",
        "All rights resered",
    ]
    s = licenses.Scanner()
    for t in texts:
        got = {(r[0], r[1]) for r in s.scan(t)}
        low = licenses.SPACE.sub(" ", licenses.fold(t))
        hits = [(lid, n, p.search(low)) for lid, n, _, _, p in s.notices]
        want = {(lid, n) for lid, n, m in hits if m}
        assert got <= want and bool(got) == bool(want)
        for _, n, a, b, e in s.scan(t):
            plain = licenses.SPACE.sub(" ", licenses.fold(n))
            assert regex.fullmatch(f"(?b)(?:{regex.escape(plain, special_only=True)}){{e<={e}}}", licenses.SPACE.sub(" ", licenses.fold(t[a:b])))
    rows = licenses.scan(make(list(enumerate(texts)), clashing=True)).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3, 5, 6}
    assert sum(r.doc_id == 3 for r in rows) == 2


def test_license_scan_finds_notices_on_either_side_of_a_better_one():
    exact, inexact = "released under the mit license", "released under the mit licence"
    s = licenses.Scanner()
    for copies in ([inexact, exact], [exact, inexact], [inexact, inexact, exact, inexact, exact], [inexact] * 3):
        for gap in (" ", "\n", ". "):
            t = gap.join(copies)
            # brute force: no window near a copy has fewer edits than the copy, by a plain table of edit distances
            want = []
            for c in copies:
                a = want[-1][1] + len(gap) if want else 0
                want.append((a, a + len(c), edits(c, exact)))
            assert all(min((edits(t[i:j], exact), abs(i - a)) for i in range(max(0, a - 2), a + 3) for j in range(b - 2, b + 3)) == (e, 0) for a, b, e in want)
            assert [x[2:] for x in s.scan(t)] == want
    assert [x[2:] for x in s.scan("all right reserved. all rights reserved.")] == [(0, 18, 1), (20, 39, 0)]


def occurrences(text, notice, k):
    """Start, end and edits of a notice's occurrences: of all windows of the text that one of fewest edits, then what is
    before and after it likewise; by a table of edit distances over the whole text."""
    n = len(notice)
    row, start = list(range(n + 1)), [0] * (n + 1)  # edits of each prefix that ends here, and the latest start for it
    best = None
    for j, c in enumerate(text, 1):
        last, last_start, row[0], start[0] = 0, j - 1, 0, j
        for i in range(1, n + 1):
            e, s = min((last + (notice[i - 1] != c), -last_start), (row[i] + 1, -start[i]), (row[i - 1] + 1, -start[i - 1]))
            last, last_start = row[i], start[i]
            row[i], start[i] = e, -s
        if row[n] <= k and (best is None or row[n] < best[2]):
            best = (start[n], j, row[n])
    if best is None:
        return []
    a, b, e = best
    return [*occurrences(text[:a], notice, k), best, *((x + b, y + b, z) for x, y, z in occurrences(text[b:], notice, k))]


def test_license_scan_loses_no_notice():
    r = np.random.default_rng(6)
    s = licenses.Scanner()

    def harmed(plain, n):
        x = list(plain)
        for _ in range(n):
            at = int(r.integers(3, len(x) - 3))
            x[at : at + int(r.integers(0, 2))] = ["#"] * int(r.integers(0, 2))
        return "".join(x)

    for _ in range(12):
        parts = []
        for i in r.integers(0, len(s.notices), 5):
            _, _, plain, k, _ = s.notices[i]
            parts += [harmed(plain, int(r.integers(0, k + 2))) for _ in range(int(r.integers(1, 3)))]
            parts += [prose(int(r.integers(99)), int(r.integers(1, 4)))] * int(r.integers(0, 2))
        text = licenses.SPACE.sub(" ", licenses.fold(" ".join(parts)))
        every = [(lid, notice, a, b, e) for lid, notice, plain, k, _ in s.notices for a, b, e in occurrences(text, plain, k)]
        want = []
        for x in sorted(every, key=lambda x: (x[4], x[2] - x[3])):
            if all(x[3] <= y[2] or x[2] >= y[3] for y in want):
                want.append(x)
        got, want = s.scan(text), sorted(want, key=lambda x: x[2])
        # an edit at an end may be told in two ways: so many characters of play
        assert [(x[1], x[4]) for x in got] == [(x[1], x[4]) for x in want], text
        assert all(abs(x[2] - y[2]) <= x[4] and abs(x[3] - y[3]) <= x[4] for x, y in zip(got, want, strict=True))


def test_overlapping_spans_of_many_notices_are_told_apart():
    s, t = licenses.Scanner(), "all rights reserved. " * 3000
    assert [x[2:4] for x in s.scan(t)] == [(21 * i, 21 * i + 19) for i in range(3000)]


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_license_odd_rows(make, odd):
    assert licenses.scan(make(odd)).count() == 0
    assert licenses.scan(make([])).count() == 0
    twice = licenses.scan(make([(1, "All rights reserved")] * 2 + [(None, "İ All rights reserved")]))
    assert sorted((r.doc_id or -1, r.span_start) for r in twice.collect()) == [(-1, 2), (1, 0), (1, 0)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe_is_that_of_the_public_library(name):
    data = file_bytes(name)
    c = bpe.Coder(read_ranks(data))
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(data), special_tokens={})
    texts = [prose(1, 300), "don't  stop\n\n x1234 éè 日本語 \U0001f600", "", " ", "a" * 500, "\t \n ", "word" * 99]
    for t in texts:
        ids = c.encode(t)
        assert ids.tolist() == enc.encode_ordinary(t)
        assert c.decode(ids) == t


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.place(k) for k in keys) == list(range(5000))
    assert h.place(b"x") == -1 and bpe.PerfectHash([]).place(b"x") == -1 and bpe.PerfectHash([b"a"]).place(b"a") == 0


def test_bpe_odd_rows(make, odd):
    rows = bpe.encoded(make(odd, clashing=True)).collect()
    assert len(rows) == len(odd)
    assert all((r.ids is None) == (r.n_tokens is None) == (r.same_text is None) for r in rows)
    assert all(r.same_text for r in rows if r.ids is not None) and sum(r.ids is None for r in rows) == 2
    assert bpe.encoded(make([])).count() == 0
    back = bpe.decoded(bpe.encoded(make(odd)))
    assert sorted(str(r.text) for r in back.collect()) == sorted(str(t) for _, t in odd)


@pytest.mark.parametrize("window", [7, 64, 100_000])
def test_packing_is_one_stream(spark, make, odd, window):
    rows = [*odd, *((50 + i, prose(i, 30 + i)) for i in range(40))]
    df = make(rows, clashing=True).repartition(5)
    got = sorted(packing.pack(df, window).collect(), key=lambda r: r.window_id)
    assert [r.window_id for r in got] == list(range(len(got)))
    assert all(r.n_tokens == len(r.tokens) == window for r in got[:-1]) and 0 < len(got[-1].tokens) <= window
    tokens = byte_tokens(file_bytes("byte_bpe_50k.tiktoken"))
    parts: list[tuple] = []
    for r in got:
        assert r.segments[0].start == 0 and r.segments[-1].end == r.n_tokens
        assert all(a.end == b.start for a, b in zip(r.segments, r.segments[1:], strict=False))
        for s in r.segments:
            if s.doc_start == 0:
                parts.append((s.doc_id, []))
            assert len(parts[-1][1]) == s.doc_start and parts[-1][0] == s.doc_id
            parts[-1][1].extend(r.tokens[s.start : s.end])
    want = [(i, np.frombuffer(tokens(t), np.uint16).tolist() + [50256]) for i, t in rows if t]
    assert sorted(map(str, parts)) == sorted(map(str, want))


def test_packing_nothing(make):
    assert packing.pack(make([])).count() == 0
    assert packing.pack(make([(1, None), (2, "")])).count() == 0

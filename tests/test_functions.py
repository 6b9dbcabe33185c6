"""Scalar and array functions against values worked out by hand."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import documents as D
from corpusmill.functions import matching
from corpusmill.functions import tables as T
from corpusmill.functions import text as X
from corpusmill.functions.stemming import stem


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("v")).first()["v"]


def L(v):
    return F.lit(v)


def cases():  # columns can only be made once there is a session
    return [
        (X.strip_nul(L("a\0b")), "ab"),
        (X.strip_nul_list(F.array(L("a\0"), L("b"))), ["a", "b"]),
        (X.strip_para(L("<PARA id=1>Title</ para >")), "Title"),
        (X.strip_para_list(F.array(L("<para>"), L("x"))), ["x"]),
        (X.collapse_space(L(" a　 b\n")), "a b"),
        (X.clamp_title(L("t" * 300)), "t" * 300),
        (X.clamp_title(L("t" * 301)), "t" * 297 + "..."),
        (X.clamp_title(L("t" * 301), L("An English title")), "An English title"),
        (X.clamp_title(L("t" * 301), L("中文标题")), "t" * 297 + "..."),
        (X.normalize_subject(L("ai and the nlp-based DNA of 3D worlds")), "AI and the NLP-Based DNA of 3D Worlds"),
        (X.normalize_subject(L("lstm networks by it")), "LSTM Networks By IT"),
        (X.normalize_subject(L("(ai) 人工智能 The")), "(AI) 人工智能 the"),
        (X.normalize_subject(L("the end")), "The End"),
        (X.title_case(L("o'brien nlp-based")), "O'Brien Nlp-Based"),
        (X.license_label(L("CC-BY-ND 4.0")), "CC BY-ND"),
        (X.license_label(L("Attribution-ShareAlike")), "CC BY-SA"),
        (X.license_label(L("cc by-nc")), "CC BY"),
        (X.license_label(L("https://creativecommons.org/publicdomain/zero/1.0")), "CC0"),
        (X.license_label(L("all rights reserved")), None),
        (X.last_part(L("oai:x.org:2024-1")), "2024-1"),
        (X.month_of_id(L("d-202401.00001")), "202401"),
        (X.safe_filename(L("a/b c")), "a_b_c"),
        (X.period_start(L("2024-02")), datetime.datetime(2024, 2, 1)),
        (X.period_end(L("2024-02")), datetime.datetime(2024, 2, 29, 23, 59, 59)),
        (X.period_end(L("2023")), datetime.datetime(2023, 12, 31, 23, 59, 59)),
        (X.period_start(L("soon")), None),
        (X.period_start(L("2024-13")), None),
        (X.address_hash(L(" 1.2.3.4 , 5.6.7.8")), "6694f83c9f476da3"),
        (X.error_type(L("PDF not available: http://x/y")), "PDF not available"),
        (X.error_type(L("Network timeout after 30s")), "Network timeout after 30s"),
        (X.error_type(L("Failed for doc-202501.00001: 404")), "Failed: 404"),
        (X.error_type(L("")), "Unknown error"),
        (X.error_type(L("word " * 30)), ("word " * 16).strip()),
        (X.api_error_class(L(429), L("")), "rate_limit"),
        (X.api_error_class(L(None).cast("int"), L("Connection reset")), "transient"),
        (X.script_ratio(L("ab中。")), 0.5),
        (X.script_ratio(L("")), 0.0),
        (X.script_chars(L("中文中")), ["中", "文"]),
        (X.has_marker(L("x 摘要: y")), True),
        (X.is_page_garbage(L("X a n i h C")), True),
        (X.is_page_garbage(L("12 - 13 -")), True),
        (X.is_page_garbage(L("A proper line of text.")), False),
        (X.is_heading(L("2.1 Methods")), True),
        (X.is_heading(L("第一章 引言")), True),
        (X.is_heading(L("methods are")), False),
        (X.is_plain_heading(L("Conclusions.")), True),
        (X.latex_body(L("x\n\\begin{document}a\n% no\nb\\end{document}y")), "a\nb"),
        (X.blank_line_paragraphs(L("aa\n\nb\n \ncc")), ["aa", "cc"]),
        (X.is_formula(L("a \\frac b")), True),
        (X.token_parity(L("a ⟪MATH_1⟫"), L("b ⟪MATH_1⟫ ⟪MATH_1⟫")), False),
        (X.token_parity(L("a ⟪MATH_1⟫"), L("b ⟪MATH_1⟫")), True),
        (X.translation_issues(L("abc [1]"), L("")), ["empty", "citations"]),
        (X.translation_issues(L("abcd"), L("efgh")), []),
        (X.strip_tokens(L("a⟪SENT⟫b")), "ab"),
        (X.alpha_ratio(L("ab12")), 0.5),
        (X.similarity(L("sitting "), L("Kitten")), 8 / 13),
        (X.coverage(L("abc"), L("abcdef")), 0.5),
        (X.matches_all(X.search_tokens(L("Networks for learning")), "learned network"), True),
        (X.matches_all(X.search_tokens(L("Networks")), "graph network"), False),
        (X.estimate_tokens(L("")), 0),
        (X.estimate_tokens(L("abc")), 1),
        (X.estimate_tokens(L("a" * 9)), 2),
        (X.has_full_body(L(None).cast("boolean"), F.array(L(" "), L("x"))), True),
        (X.json_list(L('["a","b"]')), ["a", "b"]),
        (X.json_list(L("[bad")), []),
        (X.json_list(L("one")), ["one"]),
        (X.first_url(F.array(L("x.pdf"), L("http://a/b.pdf")), ".pdf"), "http://a/b.pdf"),
        (X.archive_links(L('<a href="s.zip">x</a><a href="t.html">'), ("zip",)), ["s.zip"]),
        (X.console_tail(F.array(*[L(f"`{i}`") for i in range(12)]), 2), ["'10'", "'11'"]),
        (X.markdown_escape(L("a*b")), "a\\*b"),
        (X.first_json_object(L('say {"a": 1} now')).isNotNull(), True),
        (X.first_json_object(L("no")).isNotNull(), False),
    ]


def test_scalars(spark):
    made = cases()
    row = spark.range(1).select(*[column.alias(f"c{i}") for i, (column, _) in enumerate(made)]).first()
    wrong = [(str(column), row[i], expected) for i, (column, expected) in enumerate(made) if row[i] != expected]
    assert not wrong


def test_spans_come_in_pattern_order(value):
    got = value(X.spans(L(r"cost \$5, $x$ and $$y$$ \cite{a} [1, 2]")))
    assert [(s["pattern"], s["span"]) for s in got] == [
        ("display_dollar", "$$y$$"), ("inline_dollar", "$x$"), ("cite", r"\cite{a}"), ("bracket_cite", "[1, 2]"),
    ]


def test_nested_sum_and_amount(spark, value):
    outs = F.array(*[F.struct(L(t).alias("to"), L(v).cast("decimal(38,0)").alias("value")) for t, v in (("me", 3), ("you", 4), ("me", 5))])
    assert value(X.nested_sum(outs, "me")) == 8
    assert float(value(X.token_amount(L(1500), L(3)))) == 1.5
    assert float(value(X.token_amount(L(7), L(0)))) == 7


def test_lines_merge_to_paragraphs(value):
    lines = ["1 Introduction", "This is the first half of a long sentence that", "goes on until it ends here.", "A new paragraph starts.", "X a n i h C", "", "References"]
    got = value(D.merge_lines(F.array(*map(L, lines))))
    assert got == ["1 Introduction", "This is the first half of a long sentence that goes on until it ends here.", "A new paragraph starts.", "References"]


def test_sections_group_paragraphs(value):
    got = value(D.sections(F.array(*map(L, ["before", "Abstract", "a", "b", "Methods", "c"]))))
    assert [(s["heading"], s["paragraphs"]) for s in got] == [(None, ["before"]), ("Abstract", ["a", "b"]), ("Methods", ["c"])]


def test_fragments_join_the_next_and_the_last(value):
    long = "x" * 60
    assert value(D.merge_fragments(F.array(L("ab"), L(long), L("Abstract"), L("tail")))) == [f"ab {long}", "Abstract tail"]
    assert value(D.merge_fragments(F.array(L("ab"), L("")))) == ["ab"]
    assert value(D.clean_paragraphs(F.array(L("a  b..")))) == ["a b."]


def test_chunks_are_greedy(value):
    got = value(D.chunk_paragraphs(F.array(L("a" * 40), L("b" * 40), L("c" * 400), L("d")), 20))
    assert [len(c) for c in got] == [2, 1, 1]
    parts = F.array(F.struct(L("H").alias("heading"), F.array(L("a" * 80), L("b" * 80)).alias("paragraphs")))
    assert [c["heading"] for c in value(D.chunk_sections(parts, 20))] == ["H", "H (continued)"]


def test_markdown_has_headings_and_fences(value):
    assert value(X.markdown(F.array(L("Abstract."), L("\\alpha"), L("text")))) == "\n## Abstract\n\n```\n\\alpha\n```\n\ntext\n"


def test_mentions_keep_the_first(spark):
    paragraphs = ["See Figure 2 and Table 1.", "Figure 2: A caption of the figure.", "Fig. 3a shows.", "", "Figures 1-3 and 图S", "图表 7：说明", "Supplementary Fig. S2 " + "x" * 600]
    docs = spark.createDataFrame([(1, paragraphs), (2, None), (3, [])], "id long, p array<string>")
    rows = T.mentions(docs, "id", "p").collect()
    got = [(r["place"], r["type"], r["number"], r["paragraph"]) for r in sorted(rows, key=lambda r: r["place"])]
    assert got == [
        (1, "figure", "2", 0), (2, "figure", "3a", 2), (3, "figure", "7", 5), (4, "figure", "13", 4), (5, "figure", "S2", 6), (6, "table", "1", 0), (7, "table", "7", 5),
    ]
    held = {(r["type"], r["number"]): r for r in rows}
    assert held["figure", "2"]["confidence"] == 0.45 and not held["figure", "2"]["is_caption"]
    assert held["figure", "S2"]["caption"] == "x" * 500 + "..." and held["figure", "7"]["is_caption"]
    assert len(T.MENTIONS) == 32 and {r["id"] for r in rows} == {1}


def test_markers_stand_behind_first_mentions(spark):
    docs = spark.createDataFrame([(1, ["Figure 1 and Fig. 2a, table 3.", None, "图 1 图4b"])], "id long, p array<string>")
    rows = sorted(map(tuple, T.marked(docs, "id", "p").collect()))
    assert rows == [
        (1, 0, "Figure 1 [FIGURE:1] and Fig. 2a [FIGURE:2a], table 3 [TABLE:3].", ["FIGURE:1", "FIGURE:2a", "TABLE:3"]), (1, 1, None, []), (1, 2, "图 1 图4b [FIGURE:4b]", ["FIGURE:4b"]),
    ]


def test_sections_are_packed_together(spark):
    sections = [("A", ["a" * 80]), ("B", ["b" * 80]), ("C", ["c" * 200, "d" * 200, "e" * 40]), ("D", ["f"])]
    docs = spark.createDataFrame([(1, sections), (2, [])], "id long, s array<struct<name:string,paragraphs:array<string>>>")
    rows = sorted((r["chunk"], r["name"], len(r["paragraphs"])) for r in T.packed_chunks(docs, "id", "s", 60).collect())
    assert rows == [(0, "A", 1), (0, "B", 1), (1, "C", 1), (2, "C (continued)", 2), (3, "D", 1)]
    T.register(spark)
    docs.createOrReplaceTempView("sectioned")
    assert spark.sql("SELECT id, c.* FROM sectioned, LATERAL section_chunks(s, 60) c").count() == 5


def plain_ratio(a, b):
    """The definition: the longest block, then what lies before and behind it."""
    common = {c for c in set(b) if len(b) >= 200 and b.count(c) > len(b) // 100 + 1}

    def blocks(alo, ahi, blo, bhi):
        best = (0, alo, blo)
        for i in range(alo, ahi):
            for j in range(blo, bhi):
                k = 0
                while i + k < ahi and j + k < bhi and a[i + k] == b[j + k] and a[i + k] not in common:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
            k += 1
        return k + blocks(alo, i, blo, j) + blocks(i + k, ahi, j + k, bhi) if k else 0

    return 2 * blocks(0, len(a), 0, len(b)) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize("held", [1 << 20, 20])
def test_block_ratio_equals_a_plain_recursion(held, monkeypatch):
    import random

    monkeypatch.setattr(matching, "PAIRS", held)
    rng = random.Random(held)
    for size in (0, 1, 5, 20, 60, 60, 60, 210, 230):
        letters = rng.choice(["ab", "abcdefghij é中"])
        a = "".join(rng.choices(letters, k=size))
        b = "".join(c if rng.random() > 0.15 else rng.choice(letters) for c in a)[rng.randrange(4) :] if rng.random() > 0.3 else "".join(rng.choices(letters, k=size))
        assert matching.ratio(a, b) == plain_ratio(a, b)


def test_stems():
    # fixed values: words and stems of the published sample
    pairs = """consign consigned consigning consignment:consign consist consistency consistently:consist consolation consoling consolingly:consol consolatory:consolatori
      conspicuous conspicuously:conspicu conspiracy:conspiraci constancy:constanc knack:knack knackeries:knackeri knaves:knave kneaded:knead knightly:knight knocked:knock generously:generous
      hopping:hop hoping:hope tied:tie cries:cri gas:gas gaps:gap relational:relat electricity:electr adoption:adopt controlling:control say:say by:by agreed:agre feed:feed geology:geolog"""
    for line in pairs.replace("\n", " ").split():
        word, _, want = line.partition(":")
        if want:
            assert stem(word) == want


def test_markers_become_images(value):
    figures = F.array(*[F.struct(L(n).alias("number"), L(u).alias("url")) for n, u in (("1", "http://a"), ("1", "http://b"), ("2", "ftp://c"))])
    body = L("x [FIGURE:1] y [FIGURE:2] z [TABLE:1]")
    assert value(D.place_images(body, figures)) == "x ![Figure 1](http://a)\n![Figure 1](http://b) y  z"
    assert value(D.strip_markers(L("[FIGURE:1] a"))) == "a"


def test_summary_and_glossary(spark, value):
    df = spark.createDataFrame([(2, "b", 5), (1, "a", 4)], "o int, l string, v int")
    assert df.agg(X.summary_markdown("T", "l", "v", "o").alias("m")).first()["m"] == "# T\n\n- **a:** 4\n- **b:** 5"
    pairs = F.array(*[F.struct(L(s).alias("source"), L(t).alias("target")) for s, t in (("a", "b"), ("", "c"))])
    assert value(X.glossary_text(pairs)) == "a => b"


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_spans_work_out_each_pattern_once(spark):
    import re

    parts = ["$$a$$", "$b$", r"\[c\]", r"\(d\)", r"\begin{align*}e\end{align*}", r"\begin{equation}f\end{equation}", r"\begin{pmatrix}g\end{pmatrix}", r"\begin{cases}h\end{cases}", r"\citep{i}", r"\eqref{j}", r"\label{k}", "[1-3]", r"\$", "$", "\\", "x\ny", "[z]", r"\begin{gather}", r"\end{gather}"]
    rng = random.Random(7)
    texts = ["", None, *(" ".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(300))]

    def plain(t):
        found = []
        for name, pattern in X.SPAN_PATTERNS:
            found += [(name, m.group()) for m in re.finditer(pattern, t)]
            t = re.sub(pattern, "⟪⟫", t)
        return found

    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", X.spans("t").alias("s"))
    got = {r["id"]: r["s"] for r in df.collect()}
    assert got[1] is None
    assert all([tuple(s) for s in got[i]] == plain(t) for i, t in enumerate(texts) if t is not None)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == len(X.SPAN_PATTERNS)


def test_waiting_boxes_hold_their_own_runs_alone():
    import tracemalloc

    rng = random.Random(1)
    letters = [chr(0x4E00 + k) for k in range(300)]
    a, b = ("".join(rng.choices(letters, k=9000)) for _ in "ab")
    once = matching._runs(matching._places(a), matching._places(b), (0, len(a), 0, len(b)))
    assert len(once[0]) > 200_000
    tracemalloc.start()
    assert 0 < matching.matched(a, b) < 9000
    assert tracemalloc.get_traced_memory()[1] < 40 * 8 * len(once[0])
    tracemalloc.stop()


def test_a_box_of_no_long_runs_costs_a_look(monkeypatch):
    """Runs are found once a pair of texts; boxes only cut them."""
    asked = []
    monkeypatch.setattr(matching, "_runs", lambda x, y, box, real=matching._runs: asked.append(box) or real(x, y, box))
    rng = random.Random(2)
    letters = [chr(0x4E00 + k) for k in range(150)]
    a, b = ("".join(rng.choices(letters, k=1500)) for _ in "ab")
    assert matching.ratio(a, b) == plain_ratio(a, b) and len(asked) == 1

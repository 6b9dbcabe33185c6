"""Scalar text functions as Spark expressions: cleaning, detection, identifiers, dates, markup, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.matching import block_ratio
from corpusmill.functions.stemming import stem_all

# fixed values: code point ranges and punctuation of the Han script class
HAN_IDEOGRAPHS = (
    r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{30000}-\x{3134F}"
)
HAN_PUNCTUATION = "：；，。！？（）【】《》、…～"
HAN_MARKERS = (
    "作者：", "提交时间：", "摘要:", "分类：", "引用：", "DOI:", "CSTR:", "推荐引用方式：", "版本历史", "下载全文",
    "来自：", "关键词", "摘要：", "标题：", "日期：", "来源：", "期刊：", "状态：", "接收时间：",
)

# fixed values: spaced-out watermark letters in extracted pages, and in finished texts
PAGE_WATERMARKS = (
    r"(?i)X\s*a\s*n\s*i\s*h\s*C", r"(?i)T\s+h\s+i\s+s\s+v\s+e\s+r\s+s\s+i\s+o\s+n", r"(?i)p\s+o\s+s\s+t\s+e\s+d",
    r"\d\s+v\s+\d", r"(?i):\s*v\s*i\s*X\s*a\s*n\s*i\s*h\s*C",
)
TEXT_WATERMARKS = (r"[A-Za-z]\s+[A-Za-z]\s+[A-Za-z]\s+[A-Za-z]", r"(?i)X\s*a\s*n\s*i\s*h\s*C", r"\d\s+v\s+\d")

# fixed values: section headings
HEADINGS = (
    r"^(\d+\.?\d*\.?\d*)\s+([A-Z\x{4E00}-\x{9FFF}])",
    r"^第[一二三四五六七八九十\d]+[章节部分]\s*",
    r"^\d*\.?\s*(摘要|引言|介绍|背景|方法|方法论|结果|讨论|结论|参考文献|致谢|附录|实验|分析|总结)",
    r"(?i)^(Abstract|Introduction|Background|Methods?|Methodology|Results?|Discussion|Conclusions?|References|"
    r"Acknowledgm?ents?|Appendix|Experiment|Analysis|Summary)$",
)
HEADING_WORDS = (
    "abstract", "introduction", "background", "methods", "methodology", "results", "discussion", "conclusion", "conclusions",
    "references", "acknowledgments", "acknowledgements", "appendix", "supplementary", "materials",
)

# fixed values: licence patterns in the order in which they are tried; attribution alone only if neither form above follows
LICENSES = (
    (r"(?i)cc[- ]?by[- ]?nd|attribution[- ]?no[- ]?derivatives", "CC BY-ND"),
    (r"(?i)cc[- ]?by[- ]?sa|attribution[- ]?sharealike", "CC BY-SA"),
    (r"(?i)cc[- ]?by|attribution(?![- ]?no[- ]?derivatives|[- ]?sharealike)", "CC BY"),
    (r"(?i)cc0|public\s*domain", "CC0"),
)
LICENSE_URLS = (
    ("creativecommons.org/licenses/by/", "CC BY"), ("creativecommons.org/licenses/by-sa/", "CC BY-SA"),
    ("creativecommons.org/publicdomain/zero/", "CC0"), ("creativecommons.org/licenses/by-nd/", "CC BY-ND"),
)

STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
# fixed values: acronyms in capitals and words in small letters within subject names
ACRONYMS = ("AI", "ML", "NLP", "CV", "GPU", "CPU", "DNA", "RNA", "IOT", "API", "LLM", "LSTM", "RNN", "CNN", "GAN", "VAE", "GPT", "BERT", "IT", "CS")
SMALL_WORDS = ("and", "or", "of", "in", "on", "at", "the", "a", "an", "with", "for", "to")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_nul(c):  # H1
    return F.replace(_col(c), F.char(F.lit(0)), F.lit(""))


def strip_nul_list(c):  # H1
    return F.transform(_col(c), strip_nul)


def strip_para(c):  # H2
    return F.trim(F.regexp_replace(_col(c), r"(?i)</?\s*para\b[^>]*>", ""))


def strip_para_list(c):  # H2: elements that become empty go
    return F.filter(F.transform(_col(c), strip_para), lambda x: x != "")


def collapse_space(c):  # H3
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def looks_english(c):  # H4
    c = _col(c)
    return (F.length(c) <= 300) & ~c.rlike("[" + HAN_IDEOGRAPHS + "]") & (F.length(F.regexp_replace(c, "[^A-Za-z]", "")) >= 3)


def clamp_title(title, source=None, limit: int = 300):  # H4, C25
    """A title over the limit gives way to an English-looking source title, else is cut and ends in dots."""
    title = collapse_space(strip_para(title))
    source = F.lit(None).cast("string") if source is None else collapse_space(strip_para(source))
    cut = F.concat(F.rtrim(F.substring(title, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(title) <= limit, title).when(F.coalesce(looks_english(source), F.lit(False)), source).otherwise(cut)


def subject_word(word: Column, first: Column) -> Column:  # H6
    lead = F.regexp_extract(word, r"^[^\p{L}\p{N}]*", 0)
    tail = F.regexp_extract(word, r"[^\p{L}\p{N}]*$", 0)
    core = F.substr(word, F.length(lead) + 1, F.length(word) - F.length(lead) - F.length(tail))
    capitals = F.length(F.regexp_replace(core, r"[^\p{Lu}]", ""))
    shaped = (
        F.when(F.upper(core).isin(*ACRONYMS), F.upper(core))
        .when(core.rlike(r"\p{N}") | (capitals >= 2), core)
        .when(~first & F.lower(core).isin(*SMALL_WORDS), F.lower(core))
        .otherwise(F.concat(F.upper(F.substring(core, 1, 1)), F.lower(F.substr(core, F.lit(2)))))
    )
    return F.when(~word.rlike(r"[\p{L}\p{N}]"), word).otherwise(F.concat(lead, shaped, tail))


def normalize_subject(c):  # H6
    """Title case that leaves acronyms, digits, mixed capitals, small words and words of the Han script as they are."""
    words = F.split(collapse_space(c), " ")

    def one(word, i):
        letters = F.regexp_replace(word, r"[^\p{L}]", "")
        parts = F.transform(F.split(word, "-"), lambda p, j: F.when(p == "", p).otherwise(subject_word(p, (i == 0) & (j == 0))))
        return F.when(letters.rlike(r"^[\x{4E00}-\x{9FFF}]+$"), word).otherwise(F.array_join(parts, "-"))

    return F.array_join(F.transform(words, one), " ")


def title_case(c):  # H7: a capital after anything that isn't a letter
    step = lambda acc, ch: F.concat(acc, F.when(F.substring(acc, -1, 1).rlike(r"\p{L}"), F.lower(ch)).otherwise(F.upper(ch)))
    return F.aggregate(F.split(_col(c), ""), F.lit(""), step)


def license_label(c):  # H8
    c = _col(c)
    tests = [(c.rlike(p), label) for p, label in LICENSES] + [(F.lower(c).contains(u), label) for u, label in LICENSE_URLS]
    return reduce(lambda rest, t: F.when(t[0], t[1]).otherwise(rest), reversed(tests), F.lit(None).cast("string"))


def last_part(c, separator: str = ":"):  # H10
    return F.element_at(F.split(_col(c), F.lit(f"\\Q{separator}\\E")), -1)


def month_of_id(c):  # H10: six digits between a dash and a dot
    return F.regexp_extract(_col(c), r"-(\d{6})\.", 1)


def safe_filename(c):  # H10
    return F.regexp_replace(_col(c), r"[^A-Za-z0-9._-]", "_")


def period_start(c):  # H11: YYYY-MM-DD, YYYY-MM or YYYY; null on anything else
    c = F.trim(_col(c))
    return F.coalesce(
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))),
        F.when(c.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(F.concat(c, F.lit("-01")), F.lit("yyyy-MM-dd"))),
        F.when(c.rlike(r"^\d{4}$"), F.try_to_timestamp(F.concat(c, F.lit("-01-01")), F.lit("yyyy-MM-dd"))),
    )


def period_end(c):  # H11: the last second of the period
    c = F.trim(_col(c))
    start = period_start(c)
    day = F.when(F.length(c) == 10, F.to_date(start)).when(F.length(c) == 7, F.last_day(start)).otherwise(F.last_day(F.add_months(start, 11)))
    return F.when(start.isNotNull(), day.cast("timestamp") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"))


def day_before(as_of, days: int = 1):  # H12
    return F.date_format(F.date_sub(_col(as_of), days), "yyyy-MM-dd")


def address_hash(c):  # H13: of the first forwarded address
    return F.substring(F.sha2(F.trim(F.split(_col(c), ",")[0]), 256), 1, 16)


def error_type(c, id_pattern: str = r"\s*[a-z]+-\d{6}\.\d{5}\s*", limit: int = 80):  # H14
    """Error text without ids, long details and addresses, so that equal causes group."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(c), id_pattern, " "), r"\s+", " "), " for :", ":")
    at = F.instr(c, ": ")
    head, tail = F.trim(F.substr(c, F.lit(1), at - 1)), F.trim(F.substr(c, at + 2))
    brief = ~tail.startswith("http") & (F.length(tail) <= 50) & (tail != "") & (F.length(head) + F.length(tail) <= limit)
    c = F.when(at == 0, c).when(brief, F.concat(head, F.lit(": "), tail)).otherwise(head)
    cut = F.substring(c, 1, limit)
    word = F.regexp_extract(cut, r"^(.*) [^ ]*$", 1)
    c = F.when(F.length(c) <= limit, c).when(word != "", word).otherwise(cut)
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("Unknown error"))


def api_error_class(status, message):  # H15
    status, message = _col(status), F.lower(F.coalesce(_col(message), F.lit("")))
    return (
        F.when(status.isin(401, 403), "auth")
        .when((status == 402) | message.rlike("payment|billing|credit|balance"), "payment")
        .when((status == 429) | message.rlike("rate limit|quota|too many"), "rate_limit")
        .when((status >= 500) | message.rlike("timeout|timed out|connection|unavailable"), "transient")
        .when(status.between(400, 499), "client")
        .otherwise("unknown")
    )


def script_count(c, chars: str = HAN_IDEOGRAPHS + HAN_PUNCTUATION):  # H16: characters of a class
    return F.length(F.regexp_replace(_col(c), f"[^{chars}]", ""))


def script_ratio(c, chars: str = HAN_IDEOGRAPHS + HAN_PUNCTUATION):  # H16
    return F.coalesce(F.try_divide(script_count(c, chars).cast("double"), F.length(_col(c))), F.lit(0.0))


def script_chars(c, chars: str = HAN_IDEOGRAPHS + HAN_PUNCTUATION):  # H16: distinct ones, in order
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(c), F.lit(f"[{chars}]"), F.lit(0))))


def has_marker(c, markers=HAN_MARKERS):  # H16
    return reduce(lambda a, b: a | b, [_col(c).contains(m) for m in markers])


def is_page_garbage(c):  # H17: watermarks, page numbers and scraps of extracted pages
    c = F.trim(_col(c))
    spaces = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    spaced = (spaces / F.greatest(F.length(c), F.lit(1)) > 0.4) & c.rlike("^[A-Za-z0-9]")
    marks = reduce(lambda a, b: a | b, [c.rlike(p) for p in PAGE_WATERMARKS])
    return (F.length(c) < 5) | spaced | marks | c.rlike(r"^[\d\s.\-–—]+$")


def is_heading(c):  # H18
    c = F.trim(_col(c))
    return (F.length(c) <= 100) & reduce(lambda a, b: a | b, [c.rlike(p) for p in HEADINGS])


def is_plain_heading(c):  # H18, the formatter's form
    c = _col(c)
    word = F.rtrim(F.lower(F.trim(c)), F.lit("."))
    return F.trim(c).rlike(r"^\d+\.?\s+[A-Z]") | (word.isin(*HEADING_WORDS) & (F.length(c) < 50))


def latex_body(c):  # H21: what stands between begin and end of the document, without comment lines
    c = _col(c)
    body = F.regexp_extract(c, r"(?s)\\begin\{document\}(.*?)\\end\{document\}", 1)
    body = F.when(c.contains("\\begin{document}"), body).otherwise(c)
    return F.array_join(F.filter(F.split(body, "\n"), lambda l: ~l.rlike(r"^\s*%")), "\n")


def blank_line_paragraphs(c):  # H21
    return F.filter(F.transform(F.split(_col(c), r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) >= 2)


def is_formula(c):  # H23
    c = _col(c)
    signs = F.length(F.regexp_replace(c, r"[^∑∏∫∂∇±×÷≤≥≠≈∞∈∉⊂⊃∩∪∀∃()\[\]{}]", ""))
    return c.rlike(r"\\[a-zA-Z]+") | ((F.length(c) > 0) & (signs / F.greatest(F.length(c), F.lit(1)) > 0.3))


def markdown(paragraphs):  # H23: headings, fenced formulas and paragraphs
    def one(p):
        t = F.trim(p)
        heading = F.concat(F.lit("\n## "), F.rtrim(t, F.lit(".")), F.lit("\n"))
        fenced = F.concat(F.lit("```\n"), t, F.lit("\n```\n"))
        return F.when(is_plain_heading(t), heading).when(is_formula(t) & (F.length(t) < 200), fenced).otherwise(F.concat(t, F.lit("\n")))

    return F.array_join(F.transform(F.filter(_col(paragraphs), lambda p: F.trim(p) != ""), one), "\n")


# fixed values: formula and citation spans, tried in this order
SPAN_PATTERNS = (
    ("display_dollar", r"(?s)\$\$.+?\$\$"), ("display_bracket", r"(?s)\\\[.+?\\\]"), ("inline_paren", r"(?s)\\\(.+?\\\)"),
    ("equation", r"(?s)\\begin\{equation\*?\}.*?\\end\{equation\*?\}"), ("align", r"(?s)\\begin\{align\*?\}.*?\\end\{align\*?\}"),
    ("gather", r"(?s)\\begin\{gather\*?\}.*?\\end\{gather\*?\}"), ("multline", r"(?s)\\begin\{multline\*?\}.*?\\end\{multline\*?\}"),
    ("eqnarray", r"(?s)\\begin\{eqnarray\*?\}.*?\\end\{eqnarray\*?\}"), ("cases", r"(?s)\\begin\{cases\}.*?\\end\{cases\}"),
    ("matrix", r"(?s)\\begin\{[pbvBV]?matrix\}.*?\\end\{[pbvBV]?matrix\}"), ("inline_dollar", r"(?<!\\)\$[^$\n]+?(?<!\\)\$"),
    ("cite", r"\\cite[tp]?\{[^}]+\}"), ("ref", r"\\(?:eq)?ref\{[^}]+\}"), ("label", r"\\label\{[^}]+\}"), ("bracket_cite", r"\[\d+(?:[-,]\s*\d+)*\]"),
)


# what a text holds if one of the patterns hits in it
SPAN_MARKS = {
    "display_dollar": "$$", "display_bracket": "\\[", "inline_paren": "\\(", "inline_dollar": "$", "cite": "\\cite", "ref": "ref{", "label": "\\label{", "bracket_cite": "[",
    "cases": "\\begin{cases}", "matrix": "matrix}", **{name: f"\\begin{{{name}" for name in ("equation", "align", "gather", "multline", "eqnarray")},
}


def spans(c):  # H24: array<struct<pattern, span>>; what an earlier pattern took is out of reach of the later ones
    state = F.struct(_col(c).alias("rest"), F.array().cast("array<struct<pattern:string,span:string>>").alias("found"))

    def step(name, pattern):
        def one(s):
            found = F.transform(F.regexp_extract_all(s["rest"], F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(name).alias("pattern"), x.alias("span")))
            taken = F.struct(F.regexp_replace(s["rest"], pattern, "\u27ea\u27eb").alias("rest"), F.concat(s["found"], found).alias("found"))
            return F.when(F.contains(s["rest"], F.lit(SPAN_MARKS[name])), taken).otherwise(s)

        return one

    # a lambda's variable holds what the earlier patterns left, which nested expressions would work out again for each later one
    for name, pattern in SPAN_PATTERNS:
        state = F.transform(F.array(state), step(name, pattern))[0]
    return F.when(_col(c).isNotNull(), state["found"])


def token_parity(source, target, pattern: str = r"⟪[A-Z]+_\d+⟫"):  # H24: each token of the source exactly once in the target
    tokens = F.array_distinct(F.regexp_extract_all(_col(source), F.lit(pattern), F.lit(0)))
    found = F.regexp_extract_all(_col(target), F.lit(pattern), F.lit(0))
    return F.forall(tokens, lambda t: F.size(F.filter(found, lambda x: x == t)) == 1)


def translation_issues(source, target):  # H25
    s, t = F.coalesce(_col(source), F.lit("")), F.coalesce(_col(target), F.lit(""))
    ratio = F.try_divide(F.length(t).cast("double"), F.length(s))
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    return F.array_compact(
        F.array(
            F.when((F.trim(t) == "") & (F.trim(s) != ""), "empty"),
            F.when((F.trim(t) != "") & ((ratio < 0.5) | (ratio > 3)), "length_ratio"),
            F.when(t.contains("⟪"), "placeholder_left"),
            F.when(count(s, r"\[\d+\]") != count(t, r"\[\d+\]"), "citations"),
            F.when(count(s, r"\\[a-zA-Z]+") != count(t, r"\\[a-zA-Z]+"), "commands"),
        )
    )


def strip_tokens(c, pattern: str = r"⟪/?[A-Z_0-9]+⟫"):  # H25
    return F.regexp_replace(_col(c), pattern, "")


def alpha_ratio(c):  # H28
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(_col(c), r"[^\p{L}]", "")).cast("double"), F.length(_col(c))), F.lit(0.0))


def bare(c):  # H29: lower case, without white space
    return F.regexp_replace(F.lower(_col(c)), r"\s+", "")


def similarity(extracted, truth):  # H29: the matching-block ratio of the bare texts
    return block_ratio(bare(truth), bare(extracted))


def coverage(extracted, truth):  # H29: at most 1
    a, b = (F.length(F.regexp_replace(_col(c), r"\s+", "")) for c in (extracted, truth))
    return F.when(b == 0, 1.0).otherwise(F.least(F.lit(1.0), a / b))


def search_tokens(c, stem: bool = True):  # H30
    found = F.filter(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))
    return F.array_distinct(stem_all(found) if stem else found)


def matches_all(tokens, query: str, stem: bool = True):  # H30: every term of the query
    return F.size(F.array_except(search_tokens(F.lit(query), stem), _col(tokens))) == 0


def topic_match(text, subjects, patterns: list[tuple[str, str, str]]):  # H31
    """The first matching "kind:keyword" of patterns (kind, keyword, where: "subjects" or "text"), null if none."""
    where = {"text": F.lower(_col(text)), "subjects": F.lower(_col(subjects))}
    return F.coalesce(*[F.when(where[w].contains(k.lower()), F.lit(f"{kind}:{k}")) for kind, k, w in patterns])


def estimate_tokens(c):  # H32
    return F.when(F.length(_col(c)) > 0, F.greatest(F.lit(1), F.floor(F.length(_col(c)) / 4))).otherwise(0).cast("long")


def has_full_body(flag, paragraphs):  # H33
    return F.coalesce(_col(flag), F.exists(_col(paragraphs), lambda p: p.rlike(r"\S")), F.lit(False))


def json_list(c):  # H34: a JSON list of strings; a bare value becomes a list of one, bad JSON an empty list
    c = F.trim(_col(c))
    listed = F.from_json(c, "array<string>")
    return F.when(c.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).when(
        c.isNull() | (c == "") | c.startswith("{"), F.array().cast("array<string>")
    ).otherwise(F.array(c))


def first_url(urls, suffix: str):  # H35
    return F.filter(_col(urls), lambda u: u.startswith("http") & F.lower(u).endswith(suffix))[0]


def archive_links(html, extensions=("zip", "tar.gz", "tgz", "tex"), keyword: str = "source"):  # H35
    links = F.regexp_extract_all(_col(html), F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    pattern = r"(?i)\.(" + "|".join(e.replace(".", r"\.") for e in extensions) + r")(\?|$)|" + keyword
    return F.filter(links, lambda u: u.rlike(pattern))


def nested_sum(outputs, address: str):  # H36: values of array<struct<to, value>> that go to one address
    return F.aggregate(
        F.filter(_col(outputs), lambda o: o["to"] == address), F.lit(0).cast("decimal(38,0)"), lambda a, o: (a + o["value"]).cast("decimal(38,0)")
    )


def token_amount(raw, decimals):  # H36
    return (_col(raw).cast("decimal(38,0)").cast("double") / F.pow(F.lit(10.0), _col(decimals))).cast("decimal(38,18)")


def console_tail(logs, last: int = 10, limit: int = 500):  # H37
    logs = _col(logs)
    kept = F.slice(logs, F.greatest(F.lit(1), F.size(logs) - last + 1), last)
    return F.transform(kept, lambda x: F.substring(F.replace(x, F.lit("`"), F.lit("'")), 1, limit))


def markdown_escape(c):  # H37
    return F.regexp_replace(_col(c), r"([\\`*_{}\[\]()#+\-.!|<>])", r"\\$1")


def first_json_object(c):  # H39: inside noisy text; null unless it parses to an object
    found = F.try_parse_json(F.regexp_extract(_col(c), r"(?s)\{.*\}", 0))
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def glossary_text(pairs):  # H41: array<struct<source, target>>, pairs with a blank side left out
    whole = F.filter(_col(pairs), lambda p: (F.trim(p["source"]) != "") & (F.trim(p["target"]) != ""))
    return F.array_join(F.transform(whole, lambda p: F.concat(F.trim(p["source"]), F.lit(" => "), F.trim(p["target"]))), "\n")


def summary_markdown(title: str, label, value, order):  # A19: an aggregate over a small ordered frame
    rows = F.array_sort(F.collect_list(F.struct(_col(order).alias("o"), F.concat(F.lit("- **"), _col(label), F.lit(":** "), _col(value).cast("string")).alias("t"))))
    return F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(rows, lambda r: r["t"]), "\n"))

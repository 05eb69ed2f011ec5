"""Secret scans in DataFrame functions only.

Base kinds are patterns: assign (a keyword, a separator, a value of 6 or more), access (AKIA keys), hex (long lower-case runs).
Further kinds come from entropy: a candidate run of a character class is a secret if some window of WINDOW characters has Shannon entropy of at
least the class's threshold. A window's entropy is log2(w) - S / w with S the sum of n * log2(n) over its characters' counts. Counts and S are carried
from window to window: the character that comes adds one to its count, the one that leaves takes one from its own.
Candidates on the allow list (identifiers that are no secrets) or under a base span are dropped.

Spans are code points, end exclusive. Positions follow from the lengths of the pieces between matches, so each text is matched once per kind.
Work grows with the text's length: runs are cut into pieces of PIECE characters (that overlap by a window), running sums go by groups
of PIECE matches, and the base span that may cover a candidate is found by halving.

Defined results: null text is empty and has no spans, and an empty text has none; very long texts and runs are judged whole; ties in start go by kind as listed;
repeated rows are judged alike, row by row; an empty table gives an empty result; other columns are
kept, and one that has the name of an output is replaced; texts without any match skip all but the first test.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others, ref

#: Fixed patterns of the base kinds: (kind, pattern, group whose length counts, least length).
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a shorter run can't hold a long one, so the length may stand in the pattern
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)

#: Character classes of the entropy method: (kind, candidate runs, what they must hold each, window, least bits per character).
#: Their characters lie from FIRST_CHAR on, 80 of them, and a window has fewer than 31.
CLASSES = (
    ("entropy_hex", r"[0-9A-Fa-f]{32,}", (r"[0-9]",), 24, 2.85),
    ("entropy_alnum", r"[A-Za-z0-9]{24,}", (r"[0-9]",), 20, 3.55),
    ("entropy_base64", r"[A-Za-z0-9+/_-]{24,}", (r"[0-9]", r"[A-Z]"), 20, 3.85),
)
FIRST_CHAR, CHARS = 43, 80
PIECE = 256

#: Candidates that are no secrets: numbers, joined words, UUIDs, placeholders, long repeats, alphabets.
ALLOW = (
    r"^[0-9_/+-]+$",
    r"^[A-Za-z_/+-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|your_|test_",
    r"(?i)abcdefgh|01234567|xxxxxx|000000",
)


def _none() -> str:
    return "cast(array() as array<struct<start:int,end:int,kind:string,body:string,size:int>>)"


def _groups(n: str) -> str:
    """SQL for the numbers of the groups of PIECE items that n items make."""
    return f"sequence(0, ({n} - 1) div {PIECE})"


def _running(sums: str, add: str) -> str:
    """SQL for the array 0, s0, s0 + s1, ... of group sums; add: how `a` and `x` add up."""
    return f"aggregate({sums}, array(0), (acc, x) -> array_append(acc, transform(array(element_at(acc, -1)), a -> {add})[0]))"


def _spans(matches: str, gaps: str, sizes: str, kind: str) -> str:
    """SQL for the spans of matches, between which gaps lie; sizes: of the part whose length counts."""
    step = lambda i: f"length({gaps}[{i}]) + length({matches}[{i}])"
    members = f"sequence(g * {PIECE}, least(size({matches}), (g + 1) * {PIECE}) - 1)"
    sums = f"transform({_groups(f'size({matches})')}, g -> aggregate({members}, 0, (a, i) -> a + {step('i')}))"
    span = f"named_struct('start', a.at + length({gaps}[i]), 'end', a.at + {step('i')}, 'kind', '{kind}', 'body', {matches}[i], 'size', length({sizes}[i]))"
    each = f"aggregate({members}, named_struct('at', before[g], 'got', {_none()}), (a, i) -> named_struct('at', a.at + {step('i')}, 'got', array_append(a.got, {span})), a -> a.got)"
    return f"transform(array({_running(sums, 'a + x')}), before -> flatten(transform({_groups(f'size({matches})')}, g -> {each})))[0]"


def _scan(df: DataFrame, kind: str, pattern: str, group: int, out: str) -> DataFrame:
    """Adds out: all leftmost non-overlapping matches of pattern in s_text, as structs."""
    p = F.lit(pattern)
    none = F.expr(_none())
    hit = F.col("s_text").rlike(pattern)
    df = df.withColumn("s_hit", hit)
    m = F.when(F.col("s_hit"), F.regexp_extract_all("s_text", p, F.lit(0)))
    df = df.withColumn("s_m", m).withColumn("s_g", F.when(F.col("s_hit"), F.split("s_text", pattern, -1)))
    df = df.withColumn("s_z", F.when(F.col("s_hit"), F.regexp_extract_all("s_text", p, F.lit(group))) if group else F.col("s_m"))
    return df.withColumn(out, F.when(F.col("s_hit"), F.expr(_spans("s_m", "s_g", "s_z", kind))).otherwise(none)).drop("s_hit", "s_m", "s_g", "s_z")


def peak_entropy(text: str, window: int) -> str:
    """SQL for the largest entropy, in bits per character, of the windows of `text` (at least `window` long).

    A piece's counts are twelve to a number, five bits each. gain[n] is what S gains when a count goes from n to n + 1."""
    value = lambda n: n * math.log2(n) if n > 1 else 0.0
    gain = "array(" + ", ".join(f"{value(n + 1) - value(n)!r}D" for n in range(window + 1)) + ")"
    count = lambda x: f"cast(shiftright(a.c[{x} div 12], 5 * ({x} % 12)) & 31 as int)"
    one = lambda x: f"if(j = {x} div 12, shiftleft(1L, 5 * ({x} % 12)), 0L)"
    full, came, left = f"i >= {window}", "k[i]", f"k[i - {window}]"
    step = (
        f"named_struct('s', a.s + {gain}[{count(came)}] - if({full}, {gain}[{count(left)} + if({left} = {came}, 0, -1)], 0D), 'least', if({full}, least(a.least, a.s), a.least), "
        f"'c', transform(a.c, (v, j) -> v + {one(came)} - if({full}, {one(left)}, 0L)))"
    )
    start = f"named_struct('s', 0D, 'least', double('Infinity'), 'c', array_repeat(0L, {-(-CHARS // 12)}))"
    piece = f"transform(array(transform(split(p, ''), z -> ascii(z) - {FIRST_CHAR})), k -> aggregate(sequence(0, size(k) - 1), {start}, (a, i) -> {step}, a -> least(a.least, a.s)))[0]"
    pieces = f"transform(array(regexp_extract_all({text}, '.{{1,{PIECE}}}', 0)), q -> filter(transform(q, (x, i) -> concat(x, coalesce(left(get(q, i + 1), {window - 1}), ''))), x -> length(x) >= {window}))[0]"
    return f"(log2({window}D) - array_min(transform({pieces}, p -> {piece})) / {window}D)"


def _covered(spans: str) -> str:
    """SQL for whether one of the spans, which follow each other, meets the span x: it would be the last that starts before x ends."""
    last = f"aggregate(sequence(24, 0, -1), 0, (n, k) -> if(get({spans}, n + shiftleft(1, k) - 1).start < x.end, n + shiftleft(1, k), n)) - 1"
    return f"coalesce(get({spans}, nullif({last}, -1)).end > x.start, false)"


def scan(docs: DataFrame, *, text_col: str = "text", base_col: str = "base", spans_col: str = "spans", classes=CLASSES, allow=ALLOW) -> DataFrame:
    """Adds base_col and spans_col: arrays of (start, end, kind), by start, then kind as listed; spans_col has the base spans and those of the entropy method."""
    keep = others(docs, [base_col, spans_col])
    df = docs.select(*[ref(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(ref(text_col), F.lit("")).alias("s_text"))
    made = [f"k{i}" for i in range(len(keep))]
    kinds = []
    for kind, pattern, group, least in BASE:
        df = _scan(df, kind, pattern, group, f"b_{kind}")
        df = df.withColumn(f"b_{kind}", F.expr(f"filter(b_{kind}, x -> x.size >= {least})"))
        kinds.append(kind)
    rank = lambda names: F.expr("map(" + ", ".join(f"'{k}', {i}" for i, k in enumerate(names)) + ")")

    def ordered(col: Column, names: list[str]) -> Column:
        order = rank(names)
        sortable = F.transform(col, lambda x: F.struct(x["start"].alias("start"), F.element_at(order, x["kind"]).alias("r"), x["end"].alias("end"), x["kind"].alias("kind")))
        return F.transform(F.array_sort(sortable), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))

    base = list(kinds)
    df = df.withColumn("s_base", ordered(F.concat(*[F.col(f"b_{k}") for k in kinds]), kinds))
    for kind, runs, holds, window, bits in classes:
        df = _scan(df, kind, runs, 0, "s_c")
        tests = [*[f"x.body rlike '{h}'" for h in holds], *[f"not x.body rlike '{a}'" for a in allow], *[f"not {_covered(f'b_{k}')}" for k in base]]
        df = df.withColumn("s_c", F.expr(f"filter(s_c, x -> {' and '.join(tests)})"))
        df = df.withColumn(f"e_{kind}", F.expr(f"filter(s_c, x -> {peak_entropy('x.body', window)} >= {bits}D)")).drop("s_c")
        kinds.append(kind)
    extra = [k for k, *_ in classes]
    bare = [F.transform(F.col(f"e_{k}"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))) for k in extra]
    every = ordered(F.concat(F.col("s_base"), *bare), kinds)
    out = df.select(*[F.col(m) for m in made], F.col("s_base").alias("o_base"), every.alias("o_spans"))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("o_base").alias(base_col), F.col("o_spans").alias(spans_col))


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span in text_col replaced by mark (overlapping spans by one); null text stays null, all columns keep their place.

    The text is cut into the parts of groups of spans first, so that no span is looked for from the beginning of a long text."""
    names = docs.columns
    x = scan(docs.select(*[ref(c).alias(f"d{i}") for i, c in enumerate(names)]), text_col=f"d{names.index(text_col)}", base_col="r_base", spans_col="r_spans")
    t = f"d{names.index(text_col)}"
    # cuts: for each group of spans the pieces of text that are kept before their marks
    member = f"slice(r_spans, g * {PIECE} + 1, {PIECE})"
    ends = f"transform({_groups('size(r_spans)')}, g -> array_max(transform({member}, x -> x.end)))"
    none = "cast(array() as array<struct<a:int,z:int>>)"
    cuts = f"aggregate({member}, named_struct('at', r_before[g], 'got', {none}), (a, x) -> named_struct('at', greatest(a.at, x.end), 'got', array_append(a.got, named_struct('a', a.at, 'z', x.start))), a -> filter(a.got, y -> y.z >= y.a))"
    part = f"substring({t}, c[0].a + 1, element_at(c, -1).z - c[0].a)"
    kept = f"transform(filter(r_cuts, c -> size(c) > 0), c -> transform(array({part}), s -> array_join(transform(c, y -> concat(substring(s, y.a - c[0].a + 1, y.z - y.a), '{mark}')), ''))[0])"
    some = F.size("r_spans") > 0
    x = x.withColumn("r_before", F.when(some, F.expr(_running(ends, "greatest(a, x)"))))
    x = x.withColumn("r_cuts", F.when(some, F.expr(f"transform({_groups('size(r_spans)')}, g -> {cuts})")))
    cut = f"concat(array_join({kept}, ''), substring({t}, element_at(r_before, -1) + 1))"
    x = x.withColumn(t, F.when(F.size("r_spans") > 0, F.expr(cut)).otherwise(F.col(t)))
    return x.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(names)])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    x = scan(docs.select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return x.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The same results in DuckDB's SQL, where a window's entropy is counted anew."""
    one = lambda kind, p, g, least, src: (
        f"SELECT doc_id, '{kind}' AS kind, list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'b': m[i], 'z': length(z[i])}}) AS a"
        f" FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}', {g}) AS z FROM {src} WHERE regexp_matches(text, '{p}'))"
    )
    esc = lambda p: p.replace("'", "''")
    base = " UNION ALL ".join(f"SELECT doc_id, kind, {r} AS r, CAST(u.s AS BIGINT) AS s, CAST(u.s + length(u.b) AS BIGINT) AS e FROM (SELECT doc_id, kind, unnest(a) AS u FROM ({one(k, esc(p), g, n, 'd')})) WHERE u.z >= {n}" for r, (k, p, g, n) in enumerate(BASE))
    extra = []
    for r, (k, p, holds, w, bits) in enumerate(CLASSES, len(BASE)):
        tests = " AND ".join([*[f"regexp_matches(b, '{esc(h)}')" for h in holds], *[f"NOT regexp_matches(b, '{esc(a)}')" for a in ALLOW]])
        entropy = f"list_max(list_transform(range(1, length(b) - {w} + 2), lambda i: log2({w}) - list_sum(list_transform(list_distinct(string_split(b[i:i + {w} - 1], '')), lambda c: ({w} - length(replace(b[i:i + {w} - 1], c, ''))) * log2({w} - length(replace(b[i:i + {w} - 1], c, ''))))) / {w}))"
        extra.append(
            f"SELECT doc_id, kind, {r} AS r, s, e FROM (SELECT doc_id, kind, u.b AS b, CAST(u.s AS BIGINT) AS s, CAST(u.s + length(u.b) AS BIGINT) AS e FROM (SELECT doc_id, kind, unnest(a) AS u FROM ({one(k, esc(p), 0, 0, 'd')}))) c"
            f" WHERE {tests} AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = c.doc_id AND c.s < base.e AND base.s < c.e) AND {entropy} >= {bits}"
        )
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), base AS MATERIALIZED ({base}), extra AS ({' UNION ALL '.join(extra)}), "
        "b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) AS told FROM base GROUP BY doc_id), "
        "x AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(told, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id"
    )


ORACLE = _oracle()

"""Text scalars as Column expressions.

Everything here is built from ``regexp_replace``/``split`` and array
higher-order functions (``filter``, ``transform``, ``exists``, ``aggregate``),
so it stays inside whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions import wordlists as W

# FIXED VALUES — normalisation patterns (ASCII word class, see SURVEY §5)
URL_MENTION_HASHTAG = r"https?://\S+|[@#][A-Za-z0-9_]+"
# by ranges of what they hold: Java tries a negated class of ranges some ten times as long on each character
NON_ALNUM = r"[\x00-\x08\x0e-\x1f!-&(-/:-`{-\x{10ffff}]"  # [^a-z0-9\s']
NON_TOKEN = r"[\x00-&(-/:-`{-\x{10ffff}]+"  # [^a-z0-9']+


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lits(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


# ---------------------------------------------------------------------------
# C1 normalisation, C4 noise predicate
# ---------------------------------------------------------------------------
def normalize_text(c: Column | str) -> Column:
    """Lower; URLs, @mentions and #hashtags → space; anything but
    ``[a-z0-9\\s']`` → space; squeeze blanks; trim."""
    t = F.lower(F.coalesce(_c(c).cast("string"), F.lit("")))
    t = F.regexp_replace(t, URL_MENTION_HASHTAG, " ")
    t = F.regexp_replace(t, NON_ALNUM, " ")
    t = F.regexp_replace(t, r"\s+", " ")
    return F.trim(t)


def split_tokens(c: Column | str) -> Column:
    """The tokens of C2 with an empty one where the text begins or ends with
    something else: what is left of the text without URLs, mentions and hashtags
    is cut at runs of other characters, in one pass."""
    t = F.lower(F.coalesce(_c(c).cast("string"), F.lit("")))
    marked = t.contains("http") | t.contains("@") | t.contains("#")
    return F.split(F.when(marked, F.regexp_replace(t, URL_MENTION_HASHTAG, " ")).otherwise(t), NON_TOKEN)


def tokens(c: Column | str) -> Column:
    """C2 (array form): whitespace tokens of the normalised text, no empties."""
    return F.filter(split_tokens(c), lambda w: w != "")


def is_lower_word(w: Column) -> Column:
    """``str.islower()``: has a cased character and none is upper-case."""
    return (w == F.lower(w)) & (w != F.upper(w))


def is_alpha(w: Column) -> Column:
    return w.rlike(r"^\p{L}+$")


def is_noise(w: Column | str, stopwords: Sequence[str] = W.THEME_STOPWORDS) -> Column:
    """C4: stopword, contains ``_``, handle-like (lower-case with a digit and
    longer than 5), profanity, known handle, shorter than 3, generic word."""
    w = _c(w)
    wl = F.lower(w)
    return (
        wl.isin(*stopwords)
        | w.contains("_")
        | (is_lower_word(w) & w.rlike("[0-9]") & (F.length(w) > 5))
        | wl.isin(*W.PROFANITY)
        | wl.isin(*W.KNOWN_HANDLES)
        | (F.length(w) < 3)
        | wl.isin(*W.GENERIC_WORDS)
    )


# ---------------------------------------------------------------------------
# C9-C11 title rules
# ---------------------------------------------------------------------------
def title_words(t: Column | str) -> Column:
    """Lower-cased whitespace words with ``.,!?;:`` stripped at both ends."""
    raw = F.filter(F.split(F.trim(F.lower(F.coalesce(_c(t), F.lit("")))), r"\s+"), lambda w: w != "")
    return F.transform(raw, lambda w: F.regexp_replace(w, r"^[.,!?;:]+|[.,!?;:]+$", ""))


def meaningless_from_words(words: Column) -> Column:
    """C9 on an already split word array (see :func:`title_words`)."""
    patterns = F.array(*[_lits(p) for p in W.MEANINGLESS_PATTERNS])
    by_pattern = F.exists(patterns, lambda p: F.forall(p, lambda x: F.array_contains(words, x)))
    pos = F.array_position(words, "and")
    n = F.size(words)
    part1 = F.array_join(F.slice(words, F.lit(1), F.greatest(pos - 1, F.lit(1))), " ")
    part2 = F.array_join(F.slice(words, F.greatest(F.least(pos + 1, n), F.lit(1)), F.greatest(n - pos, F.lit(1))), " ")
    split_ok = (pos > 1) & (pos < n)
    halves = split_ok & (
        part1.isin(*W.GENERIC_SINGLE)
        | part2.isin(*W.GENERIC_SINGLE)
        | (part1.isin(*W.GENERIC_FIRST) & part2.isin(*W.GENERIC_SECOND))
        | part2.isin(*W.GENERIC_SECOND_ALONE)
        | ((part2 == "customer experience") & part1.isin(*W.GENERIC_BEFORE_EXPERIENCE))
    )
    meaningful = F.size(F.filter(words, lambda w: ~w.isin(*W.SMALL_WORDS)))
    return by_pattern | halves | (meaningful < 3)


def valid_from(t: Column, words: Column, meaningless: Column) -> Column:
    """C10 given the title, its words and its C9 flag."""
    banned = F.exists(words, lambda w: w.isin(*W.BANNED_TITLE_WORDS))
    tl = F.lower(t)
    in_taxonomy = F.exists(_lits([x.lower() for x in W.THEME_TAXONOMY]), lambda term: F.instr(tl, term) > 0)
    return (t != "") & ~meaningless & ~banned & in_taxonomy


def with_title_checks(df: DataFrame, col: str, prefix: str | None = None) -> DataFrame:
    """Add ``<prefix>_words``, ``<prefix>_meaningless`` (C9) and
    ``<prefix>_valid`` (C10) for the title column ``col``.  Each step is its
    own projection, so no sub-expression is copied into the next one."""
    p = prefix or col
    t = F.coalesce(F.col(col), F.lit(""))
    out = df.withColumn(f"{p}_words", title_words(t))
    out = out.withColumn(f"{p}_meaningless", meaningless_from_words(F.col(f"{p}_words")))
    return out.withColumn(f"{p}_valid", valid_from(t, F.col(f"{p}_words"), F.col(f"{p}_meaningless")))


def is_meaningless(t: Column | str) -> Column:
    """C9 as one Column (fine for a single use; use :func:`with_title_checks`
    when the result feeds further title rules)."""
    return meaningless_from_words(title_words(t))


def is_valid_title(t: Column | str) -> Column:
    """C10 as one Column: non-empty, not meaningless, no banned word, and one
    of the taxonomy terms as a case-insensitive substring."""
    t = F.coalesce(_c(t), F.lit(""))
    words = title_words(t)
    return valid_from(t, words, meaningless_from_words(words))


def clean_title(t: Column | str) -> Column:
    """C11 helper: trim blanks, then outer double quotes, then outer single
    quotes; squeeze inner blanks."""
    x = F.coalesce(_c(t), F.lit(""))
    x = F.regexp_replace(x, r"^\s+|\s+$", "")
    x = F.regexp_replace(x, r'^"+|"+$', "")
    x = F.regexp_replace(x, r"^'+|'+$", "")
    return F.regexp_replace(x, r"\s+", " ")


def _drop_prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def with_sanitized_title(df: DataFrame, primary: str, fallback: Column | str, out_col: str,
                         default: str = W.DEFAULT_TITLE) -> DataFrame:
    """C11: cleaned primary if valid, else cleaned fallback if valid, else the
    default title."""
    out = df.withColumn("__sp", clean_title(F.col(primary))).withColumn("__sf", clean_title(_c(fallback)))
    out = with_title_checks(with_title_checks(out, "__sp"), "__sf")
    out = out.withColumn(out_col, F.when(F.col("__sp_valid"), F.col("__sp"))
                         .when(F.col("__sf_valid"), F.col("__sf")).otherwise(F.lit(default)))
    return _drop_prefixed(out, "__s")


# ---------------------------------------------------------------------------
# C12 fallback title from keywords, C13 generated-title cleanup, C15 display
# ---------------------------------------------------------------------------
def _title_case(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def _keyword_map() -> Column:
    keys = list(W.KEYWORD_TITLES)
    return F.map_from_arrays(_lits(keys), _lits([W.KEYWORD_TITLES[k] for k in keys]))


def prompt_keywords(kws: Column | str, limit: int = 8) -> Column:
    """Keywords that are not noise, longer than 3, alphabetic; first ``limit``."""
    kept = F.filter(_c(kws), lambda k: ~is_noise(k) & (F.length(k) > 3) & ~k.rlike(r"^[0-9]+$") & is_alpha(k))
    return F.slice(kept, 1, limit)


def title_prompt_terms(kws: Column | str) -> Column:
    """The business terms among the prompt keywords, or default ones."""
    kept = F.filter(prompt_keywords(kws), lambda k: F.lower(k).isin(*W.PROMPT_BUSINESS_TERMS))
    return F.when(F.size(kept) > 0, kept).otherwise(_lits(W.PROMPT_DEFAULT_TERMS))


def summary_terms(kws: Column | str, limit: int, defaults: Sequence[str]) -> Column:
    """Of the first ``limit`` keywords that are not noise and longer than 3
    the business terms and alphabetic words longer than 5, or ``defaults``.  A
    phrase counts among the first ones, though it is never kept."""
    first = F.slice(F.filter(_c(kws), lambda k: ~is_noise(k) & (F.length(k) > 3)), 1, limit)
    kept = F.filter(first, lambda k: F.lower(k).isin(*W.SUMMARY_BUSINESS_TERMS) | ((F.length(k) > 5) & is_alpha(k)))
    return F.when(F.size(kept) > 0, kept).otherwise(_lits(defaults))


def with_fallback_title(df: DataFrame, kws: str, out_col: str, default: str = W.DEFAULT_TITLE) -> DataFrame:
    """Compose a title from up to four keywords through the business
    dictionary (``A and B`` / ``A Concerns`` / ``A Issues`` / ``A and
    Customer Experience``), then sanitise it (C11)."""
    kmap = _keyword_map()
    out = df.withColumn("__fk_clean", prompt_keywords(F.col(kws), 8))
    out = out.withColumn("__fk_filt", F.filter(F.col("__fk_clean"),
                                               lambda k: ~F.lower(k).isin(*W.THEME_STOPWORDS) & (F.length(k) > 2)))

    def step(acc, kw):
        mapped = F.try_element_at(kmap, F.lower(kw))
        titled_ok = ~is_noise(kw) & (F.length(kw) > 4) & is_alpha(kw) & (kw != F.upper(kw))
        return (
            F.when(mapped.isNotNull(),
                   F.when(F.array_contains(acc, mapped), acc).otherwise(F.concat(acc, F.array(mapped))))
            .when(titled_ok, F.concat(acc, F.array(_title_case(kw))))
            .otherwise(acc)
        )

    out = out.withColumn("__fk_terms", F.aggregate(F.slice(F.col("__fk_filt"), 1, 4),
                                                   F.array().cast("array<string>"), step))
    m0, m1 = F.try_element_at(F.col("__fk_terms"), F.lit(1)), F.try_element_at(F.col("__fk_terms"), F.lit(2))
    out = out.withColumn("__fk_m0", m0).withColumn("__fk_pair", F.concat_ws(" and ", m0, m1))
    out = with_title_checks(out, "__fk_pair")
    m0 = F.col("__fk_m0")
    out = out.withColumn("__fk_after_pair", F.when(~F.col("__fk_pair_meaningless"), F.col("__fk_pair"))
                         .when(m0.isin(*W.CONCERN_TERMS), F.concat(m0, F.lit(" Concerns")))
                         .when(m0.isin(*W.ISSUE_TERMS), F.concat(m0, F.lit(" Issues")))
                         .otherwise(F.concat(m0, F.lit(" and Customer Experience"))))
    out = out.withColumn("__fk_single", F.when(m0.isin(*W.CONCERN_TERMS), F.concat(m0, F.lit(" Concerns")))
                         .when(m0.isin(*W.ISSUE_TERMS), F.concat(m0, F.lit(" Issues")))
                         .when(m0.isin(*W.STANDALONE_TERMS), m0)
                         .otherwise(F.concat(m0, F.lit(" and Customer Experience"))))
    out = out.withColumn("__fk_valid2", F.filter(F.slice(F.col("__fk_filt"), 1, 2),
                                                 lambda k: ~is_noise(k) & (F.length(k) > 3)))
    v0, v1 = F.try_element_at(F.col("__fk_valid2"), F.lit(1)), F.try_element_at(F.col("__fk_valid2"), F.lit(2))
    out = out.withColumn("__fk_raw", F.concat_ws(" and ", F.coalesce(F.try_element_at(kmap, F.lower(v0)), _title_case(v0)),
                                                 F.coalesce(F.try_element_at(kmap, F.lower(v1)), _title_case(v1))))
    out = with_title_checks(out, "__fk_raw")
    out = out.withColumn("__fk_title", F.when(F.size("__fk_terms") >= 2, F.col("__fk_after_pair"))
                         .when(F.size("__fk_terms") == 1, F.col("__fk_single"))
                         .when((F.size("__fk_filt") > 0) & (F.size("__fk_valid2") >= 2) & ~F.col("__fk_raw_meaningless"),
                               F.col("__fk_raw"))
                         .otherwise(F.lit(default)))
    out = with_sanitized_title(out, "__fk_title", F.lit(default), out_col, default)
    return _drop_prefixed(out, "__fk")


def with_generated_title(df: DataFrame, gen: str, fallback: str, out_col: str) -> DataFrame:
    """Strip quotes and ``Theme:``/``Title:``/``Name:``/``*`` markers, drop
    noise words, reject short, noisy or meaningless text (→ fallback),
    title-case with small words kept lower, then sanitise against the
    fallback."""
    t = F.regexp_replace(F.coalesce(F.col(gen), F.lit("")), r"^\s+|\s+$", "")
    t = F.regexp_replace(t, r'^"+|"+$', "")
    t = F.regexp_replace(t, r"^'+|'+$", "")
    for marker in ("Theme: ", "Title: ", "Name: ", "**", "*"):
        t = F.replace(t, F.lit(marker), F.lit(""))
    out = df.withColumn("__g_t", F.regexp_replace(t, r"^\s+|\s+$", ""))
    strip = lambda w: F.regexp_replace(F.lower(w), r"^[.,!?;:]+|[.,!?;:]+$", "")
    out = out.withColumn("__g_kept", F.filter(F.filter(F.split(F.col("__g_t"), r"\s+"), lambda w: w != ""),
                                              lambda w: ~is_noise(strip(w))))
    out = out.withColumn("__g_t2", F.when(F.size("__g_kept") > 0, F.array_join("__g_kept", " "))
                         .otherwise(F.col("__g_t")))
    out = out.withColumn("__g_w2", F.filter(F.split(F.col("__g_t2"), r"\s+"), lambda w: w != ""))
    out = out.withColumn("__g_noisy", F.exists("__g_w2", lambda w: is_noise(strip(w))))
    out = out.withColumn("__g_cased", F.array_join(F.transform(
        "__g_w2", lambda w, i: F.when((i == 0) | ~F.lower(w).isin(*W.SMALL_WORDS), _title_case(w))
        .otherwise(F.lower(w))), " "))
    out = with_title_checks(with_title_checks(out, "__g_t2"), "__g_cased")
    out = with_sanitized_title(out, "__g_cased", F.col(fallback), "__g_sane")
    fb = F.col(fallback)
    out = out.withColumn(out_col, F.when(F.length("__g_t2") <= 5, fb).when(F.col("__g_noisy"), fb)
                         .when(F.col("__g_t2_meaningless"), fb).when(F.col("__g_cased_meaningless"), fb)
                         .otherwise(F.col("__g_sane")))
    return _drop_prefixed(out, "__g")


def display_theme_name(raw: Column | str, overrides: dict[str, str] | None = None) -> Column:
    """Strip outer double quotes, trim, squeeze blanks; case-insensitive
    override map."""
    ov = W.THEME_DISPLAY_OVERRIDES if overrides is None else overrides
    x = F.coalesce(_c(raw), F.lit(""))
    x = F.regexp_replace(x, r'^"+|"+$', "")
    x = F.regexp_replace(F.trim(x), r"\s+", " ")
    if not ov:
        return x
    keys = [k.lower() for k in ov]
    m = F.map_from_arrays(_lits(keys), _lits(list(ov.values())))
    return F.coalesce(F.try_element_at(m, F.lower(x)), x)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """|A∩B| / |A∪B| of two arrays (0.0 when both empty)."""
    a, b = _c(a), _c(b)
    u = F.size(F.array_union(F.array_distinct(a), F.array_distinct(b)))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))

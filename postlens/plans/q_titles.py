"""Registered title queries (C9-C13, C15, C16, J6) over every conversation turn.

The driver's texts hold no retail words, so each turn also gives a title and a
keyword list made of its own words and of the fixed vocabularies, picked by
arithmetic on its ids.  The twins compute every rule anew, step by step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions import wordlists as W
from postlens.functions.text import (display_theme_name, prompt_keywords, summary_terms, title_prompt_terms, tokens,
                                     with_fallback_title, with_generated_title, with_sanitized_title, with_title_checks)
from postlens.operators import themes as J
from postlens.plans.q_text import noise_sql, norm_sql, _q
from postlens.plans.registry import register
from postlens.sources.fixtures import read_table

FALLBACK = "Order Fulfillment Issues"
#: Kinds of made-up titles.
KINDS = 8


def _list(words: Sequence[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _pick(words: Sequence[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(i, F.lit(len(words))) + 1).cast("int"))


def _pick_sql(words: Sequence[str], i: str) -> str:
    return f"{_list(words)}[({i}) % {len(words)} + 1]"


PATTERNS = [" ".join(p) for p in W.MEANINGLESS_PATTERNS]


# ---------------------------------------------------------------------------
# twins of the rules
# ---------------------------------------------------------------------------
def clean_sql(x: str) -> str:
    """C11's clean-up of a title."""
    for pattern, to in ((r"^\s+|\s+$", ""), ('^"+|"+$', ""), ("^''+|''+$", ""), (r"\s+", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def _pieces(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def _bare(w: str) -> str:
    return f"regexp_replace(lower({w}), '^[.,!?;:]+|[.,!?;:]+$', '', 'g')"


def checks_sql(name: str, src: str, col: str, p: str) -> str:
    """CTEs that end in ``name``: ``src`` with ``p_w`` (words), ``p_m`` (C9) and ``p_v`` (C10) of the title ``col``."""
    patterns = " or ".join(f"list_has_all({p}_w, {_list(x)})" for x in W.MEANINGLESS_PATTERNS)
    terms = " or ".join(f"contains(lower(coalesce({col}, '')), '{t.lower()}')" for t in W.THEME_TAXONOMY)
    return f"""
{name}_1 as (select *, list_transform({_pieces(f"lower(coalesce({col}, ''))")}, lambda w: {_bare('w')}) as {p}_w from {src}),
{name}_2 as (select *, coalesce(list_position({p}_w, 'and'), 0) as {p}_at from {name}_1),
{name}_3 as (select *, case when {p}_at > 1 and {p}_at < len({p}_w) then array_to_string({p}_w[1:{p}_at - 1], ' ') end as {p}_one,
  case when {p}_at > 1 and {p}_at < len({p}_w) then array_to_string({p}_w[{p}_at + 1:], ' ') end as {p}_two from {name}_2),
{name}_4 as (select *, {patterns} or coalesce({p}_one in {_q(W.GENERIC_SINGLE)} or {p}_two in {_q(W.GENERIC_SINGLE)}
  or ({p}_one in {_q(W.GENERIC_FIRST)} and {p}_two in {_q(W.GENERIC_SECOND)}) or {p}_two in {_q(W.GENERIC_SECOND_ALONE)}
  or ({p}_two = 'customer experience' and {p}_one in {_q(W.GENERIC_BEFORE_EXPERIENCE)}), false)
  or len(list_filter({p}_w, lambda w: w not in {_q(W.SMALL_WORDS)})) < 3 as {p}_m from {name}_3),
{name} as (select *, coalesce({col}, '') <> '' and not {p}_m and not list_has_any({p}_w, {_list(W.BANNED_TITLE_WORDS)}) and ({terms}) as {p}_v from {name}_4)"""


def sane_sql(name: str, src: str, primary: str, fallback: str, p: str) -> str:
    """CTEs that end in ``name``: ``src`` with ``p``, the sanitised title (C11)."""
    return f"""
{name}_p as (select *, {clean_sql(f"coalesce({primary}, '')")} as {p}_p, {clean_sql(f"coalesce({fallback}, '')")} as {p}_f from {src}),
{checks_sql(name + '_q', name + '_p', p + '_p', p + '_p')},
{checks_sql(name + '_r', name + '_q', p + '_f', p + '_f')},
{name} as (select *, case when {p}_p_v then {p}_p when {p}_f_v then {p}_f else '{W.DEFAULT_TITLE}' end as {p} from {name}_r)"""


def title_case_sql(w: str) -> str:
    return f"upper(substr({w}, 1, 1)) || lower(substr({w}, 2))"


def _rules_sql(source: str, keep: str) -> str:
    """All title rules of the column ``title`` of ``source``."""
    text = r"regexp_replace(coalesce(title, ''), '^\s+|\s+$', '', 'g')"
    text = f"""regexp_replace(regexp_replace({text}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')"""
    for marker in ("Theme: ", "Title: ", "Name: ", "**", "*"):
        text = f"replace({text}, '{marker}', '')"
    small = _q(W.SMALL_WORDS)
    return f"""
with s as ({source}),
{checks_sql('a', 's', 'title', 't')},
{sane_sql('b', 'a', 'title', f"'{FALLBACK}'", 'sanitized')},
g1 as (select *, regexp_replace({text}, '^\\s+|\\s+$', '', 'g') as g_t from b),
g2 as (select *, list_filter({_pieces('g_t')}, lambda w: not {noise_sql(_bare('w'))}) as g_kept from g1),
g3 as (select *, case when len(g_kept) > 0 then array_to_string(g_kept, ' ') else g_t end as g_t2 from g2),
g4 as (select *, {_pieces('g_t2')} as g_w from g3),
g5 as (select *, len(list_filter(g_w, lambda w: {noise_sql(_bare('w'))})) > 0 as g_noisy,
  array_to_string(list_transform(g_w, lambda w, i: case when i = 1 or lower(w) not in {small} then {title_case_sql('w')} else lower(w) end), ' ') as g_cased from g4),
{checks_sql('g6', 'g5', 'g_t2', 'gt')},
{checks_sql('g7', 'g6', 'g_cased', 'gc')},
{sane_sql('g8', 'g7', 'g_cased', 'sanitized', 'g_sane')},
d as (select *, case when length(g_t2) <= 5 or g_noisy or gt_m or gc_m then sanitized else g_sane end as cleaned,
  regexp_replace(trim(regexp_replace(coalesce(title, ''), '^"+|"+$', '', 'g')), '\\s+', ' ', 'g') as shown from g8)
select {keep}, t_m as meaningless, t_v as valid, sanitized, cleaned,
  {"".join(f"case when lower(shown) = '{k.lower()}' then '{v}' else " for k, v in W.THEME_DISPLAY_OVERRIDES.items())}shown{" end" * len(W.THEME_DISPLAY_OVERRIDES)} as display
from d
"""


def _title_rules(rows, title: str):
    rows = with_title_checks(rows, title, "t")
    rows = with_sanitized_title(rows, title, F.lit(FALLBACK), "sanitized")
    rows = with_generated_title(rows, title, "sanitized", "cleaned")
    return rows.select("conv_id", "turn", *([title] if title == "title" else []), F.col("t_meaningless").alias("meaningless"),
                       F.col("t_valid").alias("valid"), "sanitized", "cleaned", display_theme_name(F.col(title)).alias("display"))


@register("title_rules_conversations", "C9,C10,C11,C13,C15", lambda: _rules_sql(
    "select conv_id, turn, text as title from conversations", "conv_id, turn"))
def q_title_rules(spark, d):
    """Every conversation turn treated as a candidate theme title: C9/C10 flags, C11 sanitised title, C13 clean-up as if it
    were generated text, C15 display name."""
    return _title_rules(read_table(spark, d, "conversations").select("conv_id", "turn", "text"), "text")


def _made_titles_sql() -> str:
    n, tax = "(conv_id * 7 + turn)", W.THEME_TAXONOMY
    one, two = _pick_sql(tax, n), _pick_sql(tax, f"{n} * 5 + 3")
    norm = norm_sql("text")
    kinds = [f"{one} || ' and ' || {two}", f"{one} || ' Issues'", f"coalesce(first_word, 'their') || ' and ' || {one}",
             f"'\"Theme: **' || lower({one}) || '** of the ' || coalesce(first_word, 'many') || ', ' || role || '\"'",
             f"{_pick_sql(W.GENERIC_FIRST, n)} || ' and ' || {_pick_sql(W.GENERIC_SECOND, n)}",
             f"{_pick_sql(PATTERNS, n)} || ' ' || {one}", f"'  ' || {_pick_sql(W.BANNED_TITLE_WORDS, n)} || '  ' || {two} || ' Concerns'",
             "'\"Hidden and  Customer SUPPORT\"'"]
    cases = " ".join(f"when {i} then {k}" for i, k in enumerate(kinds))
    return (f"select conv_id, turn, case {n} % {KINDS} {cases} end as title from (select *, "
            f"case when text is not null then nullif(string_split({norm}, ' ')[1], '') end as first_word from conversations)")


def _made_titles(spark, d):
    n = F.col("conv_id") * 7 + F.col("turn")
    one, two = _pick(W.THEME_TAXONOMY, n), _pick(W.THEME_TAXONOMY, n * 5 + 3)
    word = F.try_element_at(tokens("text"), F.lit(1))
    kinds = [F.concat(one, F.lit(" and "), two), F.concat(one, F.lit(" Issues")), F.concat(F.coalesce(word, F.lit("their")), F.lit(" and "), one),
             F.concat(F.lit('"Theme: **'), F.lower(one), F.lit("** of the "), F.coalesce(word, F.lit("many")), F.lit(", "), F.col("role"), F.lit('"')),
             F.concat(_pick(W.GENERIC_FIRST, n), F.lit(" and "), _pick(W.GENERIC_SECOND, n)), F.concat(_pick(PATTERNS, n), F.lit(" "), one),
             F.concat(F.lit("  "), _pick(W.BANNED_TITLE_WORDS, n), F.lit("  "), two, F.lit(" Concerns")), F.lit('"Hidden and  Customer SUPPORT"')]
    title = F.lit(None).cast("string")
    for i, k in enumerate(kinds):
        title = F.when(n % KINDS == i, k).otherwise(title)
    return read_table(spark, d, "conversations").select("conv_id", "turn", title.alias("title"))


@register("title_rules_turns", "C9,C10,C11,C13,C15", lambda: _rules_sql(_made_titles_sql(), "conv_id, turn, title"))
def q_title_turns(spark, d):
    """A title made of each turn's words, role and the vocabularies, under the same rules: two terms, one, a word and a term,
    a marked-up answer, generic halves, meaningless patterns, banned words, an overridden name."""
    return _title_rules(_made_titles(spark, d), "title")


# ---------------------------------------------------------------------------
# C12, C16, J6 over keyword lists
# ---------------------------------------------------------------------------
KEYS = list(W.KEYWORD_TITLES)
NOISE = [*W.GENERIC_WORDS, "ab12cd34", "a_b", "waterproof", "cables", "customer service", "Tariff"]


def _keywords(spark, d):
    n = F.col("conv_id") * 11 + F.col("turn")
    one, two, three = (_pick(KEYS, n * k + k) for k in (1, 3, 7))
    noise, other = _pick(NOISE, n), _pick(NOISE, n * 3 + 1)
    words = F.slice(tokens("text"), 1, 6)
    lists = [F.array(one), F.array(one, two), words, F.concat(F.array(noise, one), words), F.array(other, noise, two, three, one),
             F.array(noise, other), F.array().cast("array<string>")]
    kw = lists[-1]
    for i, k in enumerate(lists):
        kw = F.when(n % len(lists) == i, k).otherwise(kw)
    return read_table(spark, d, "conversations").select("conv_id", "turn", kw.alias("kw"))


def _keywords_sql() -> str:
    n = "(conv_id * 11 + turn)"
    one, two, three = (_pick_sql(KEYS, f"{n} * {k} + {k}") for k in (1, 3, 7))
    noise, other = _pick_sql(NOISE, n), _pick_sql(NOISE, f"{n} * 3 + 1")
    words = "list_filter(string_split(norm, ' '), lambda w: w <> '')[1:6]"
    lists = [f"[{one}]", f"[{one}, {two}]", words, f"list_concat([{noise}, {one}], {words})", f"[{other}, {noise}, {two}, {three}, {one}]",
             f"[{noise}, {other}]", "cast([] as varchar[])"]
    cases = " ".join(f"when {i} then {k}" for i, k in enumerate(lists))
    return f"select conv_id, turn, case {n} % {len(lists)} {cases} end as kw from (select *, {norm_sql('text')} as norm from conversations)"


def _fallback_sql() -> str:
    mapped = lambda w: f"(case lower({w}) " + " ".join(f"when '{k}' then '{v}'" for k, v in W.KEYWORD_TITLES.items()) + " end)"
    alpha = lambda w: f"regexp_full_match({w}, '\\p{{L}}+')"
    fine = lambda w: f"not {noise_sql(w)} and length({w}) > 3"
    entry = ", ".join(f"{mapped(f'filt[{i}]')} as m{i}, case when not {noise_sql(f'filt[{i}]')} and length(filt[{i}]) > 4 and {alpha(f'filt[{i}]')} "
                      f"and filt[{i}] <> upper(filt[{i}]) then {title_case_sql(f'filt[{i}]')} end as c{i}" for i in range(1, 5))
    term = ", ".join(f"case when m{i} is null then c{i} " + (f"when list_contains([{', '.join(f'coalesce(m{j}, c{j})' for j in range(1, i))}], m{i}) then null " if i > 1 else "")
                     + f"else m{i} end" for i in range(1, 5))
    alone = f"when t1 in {_q(W.CONCERN_TERMS)} then t1 || ' Concerns' when t1 in {_q(W.ISSUE_TERMS)} then t1 || ' Issues'"
    named = lambda v: f"coalesce({mapped(v)}, {title_case_sql(v)})"
    some = lambda limit, default: (f"list_filter(list_filter(kw, lambda w: {fine('w')})[1:{limit}], lambda w: lower(w) in {_q(W.SUMMARY_BUSINESS_TERMS)} "  # noqa: E731
                                   f"or (length(w) > 5 and {alpha('w')}))", _list(default))
    first = lambda pair: f"case when len({pair[0]}) > 0 then {pair[0]} else {pair[1]} end"
    asked = (f"list_filter(clean, lambda w: lower(w) in {_q(W.PROMPT_BUSINESS_TERMS)})", _list(W.PROMPT_DEFAULT_TERMS))
    return f"""
with s as ({_keywords_sql()}),
k1 as (select *, list_filter(kw, lambda w: {fine('w')} and {alpha('w')})[1:8] as clean from s),
k2 as (select *, list_filter(clean, lambda w: lower(w) not in {_q(W.THEME_STOPWORDS)}) as filt from k1),
k3 as (select *, {entry} from k2),
k4 as (select *, list_filter([{term}], lambda w: w is not null) as terms from k3),
k5 as (select *, terms[1] as t1, concat_ws(' and ', terms[1], terms[2]) as pair, list_filter(filt[1:2], lambda w: {fine('w')}) as v from k4),
{checks_sql('k6', 'k5', 'pair', 'pair')},
k7 as (select *, concat_ws(' and ', {named('v[1]')}, {named('v[2]')}) as raw from k6),
{checks_sql('k8', 'k7', 'raw', 'raw')},
k9 as (select *, case when len(terms) >= 2 then case when not pair_m then pair {alone} else t1 || ' and Customer Experience' end
  when len(terms) = 1 then case {alone} when t1 in {_q(W.STANDALONE_TERMS)} then t1 else t1 || ' and Customer Experience' end
  when len(v) >= 2 and not raw_m then raw else '{W.DEFAULT_TITLE}' end as composed from k8),
{sane_sql('z', 'k9', 'composed', f"'{W.DEFAULT_TITLE}'", 'title')}
select conv_id, turn, array_to_string(kw, ',') as kw, array_to_string(clean, ',') as prompt_kws, array_to_string({first(asked)}, ',') as asked,
  array_to_string({first(some(6, W.SUMMARY_PROMPT_DEFAULT_TERMS))}, ',') as described, title,
  title || ': This theme focuses on ' || array_to_string(clean[1:4], ', ') || '. {W.THEME_SUMMARY_TAIL}' as summary from z
"""


@register("fallback_titles_turns", "C12,C16,J6,C11", _fallback_sql)
def q_fallback_turns(spark, d):
    """Keyword lists of each turn's words, business words and noise: what a prompt is given of them (C16), the title composed
    of them (C12) and the template's summary (J6)."""
    t = _keywords(spark, d)
    t = with_fallback_title(t, "kw", "title")
    listed = lambda c: F.array_join(c, ",")
    return t.select("conv_id", "turn", listed(F.col("kw")).alias("kw"), listed(prompt_keywords("kw")).alias("prompt_kws"),
                    listed(title_prompt_terms("kw")).alias("asked"), listed(summary_terms("kw", 6, W.SUMMARY_PROMPT_DEFAULT_TERMS)).alias("described"),
                    "title", J.template_summary("title", prompt_keywords("kw")).alias("summary"))


# ---------------------------------------------------------------------------
# C17 prompts of themes
# ---------------------------------------------------------------------------
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _prompts_sql() -> str:
    before, after = W.TITLE_REQUEST.split("{kws}")
    request, rest = W.SUMMARY_REQUEST.split("{title}")
    terms, rest = rest.split("{kws}")
    examples, last = rest.split("{examples}")
    clip = "coalesce(substr(coalesce(posts[{i}], ''), 1, 150), '')"
    samples = f"case len(posts) when 0 then '' else {_quoted(W.TITLE_SAMPLES_HEAD)} || '1. ' || {clip.format(i=1)} || '...' " \
              f"|| case when len(posts) > 1 then chr(10) || '2. ' || {clip.format(i=2)} || '...' else '' end || chr(10) || chr(10) end"
    return f"""
with f as ({_fallback_sql()}),
p as (select conv_id, turn, list_filter([coalesce(text, ''), role], lambda x: x <> 'assistant') as posts from conversations),
x as (select f.*, posts from f join p on f.conv_id = p.conv_id and f.turn = p.turn)
select conv_id, turn, sha256({_quoted(W.TITLE_INSTRUCTION + chr(10) + before)} || array_to_string(string_split(asked, ',')[1:8], ', ') || {_quoted(after)} || {samples}
    || {_quoted(W.TITLE_REQUEST_TAIL)}) as title_prompt_sha256,
  {_quoted(W.SUMMARY_INSTRUCTION + chr(10) + chr(10) + request)} || title || {_quoted(terms)} || replace(described, ',', ', ') || {_quoted(examples)}
    || cast(to_json(posts) as varchar) || {_quoted(last)} as summary_prompt
from x
"""


@register("theme_prompts_turns", "C17,C16,C12", _prompts_sql)
def q_theme_prompts(spark, d):
    """Both prompts of a theme from each turn's keyword list, composed title, text and role (an assistant's role is no post)."""
    posts = read_table(spark, d, "conversations").select("conv_id", "turn", F.filter(
        F.array(F.coalesce("text", F.lit("")), F.col("role")), lambda x: x != "assistant").alias("posts"))
    t = with_fallback_title(_keywords(spark, d).join(posts, ["conv_id", "turn"]), "kw", "title")
    return t.select("conv_id", "turn", F.sha2(J.title_prompt("kw", "posts"), 256).alias("title_prompt_sha256"),
                    J.summary_prompt("title", "kw", "posts").alias("summary_prompt"))

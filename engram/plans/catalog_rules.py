"""The text rules with all their fixed values, over the supplied rows: each value and pattern is hit by some of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.categories import CANONICAL, LOWER, NAMES
from .catalog import query


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def one_of(values, index: str) -> str:
    """SQL of the value at a place."""
    return f"list_extract([{', '.join(lit(v) for v in values)}], CAST({index} AS BIGINT) + 1)"


def picked(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def mapped(names: dict[str, str], value: str) -> str:
    return f"map_extract(MAP {{{', '.join(f'{lit(k)}: {lit(v)}' for k, v in names.items())}}}, {value})[1]"


# --- categories ---

KINDS = list(NAMES) + list(CANONICAL) + ["my backend notes", "Nothing Known", "  Security  ", "DATA and patterns", "x"]
FORM = f"CASE (doc_id // {len(KINDS)}) % 3 WHEN 0 THEN v WHEN 1 THEN upper(v) ELSE ' ' || v || ' ' END"
HELD = " ".join(f"WHEN contains(low, {lit(c)}) THEN {lit(c)}" for c in CANONICAL)


@query(f"""SELECT id, value, CASE WHEN value IS NULL THEN NULL ELSE coalesce({mapped(NAMES, 'value')}, CASE WHEN low IN ({', '.join(map(lit, CANONICAL))}) THEN low END, {mapped(LOWER, 'low')}, CASE {HELD} ELSE low END) END AS category
 FROM (SELECT id, value, lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) AS low FROM (SELECT doc_id AS id, {FORM} AS value FROM (SELECT doc_id, {one_of(KINDS, f'doc_id % {len(KINDS)}')} AS v FROM documents)))""")
def category_rules(t):
    """Every known name, as it is, in capitals, and between blanks."""
    i, n = F.col("doc_id"), len(KINDS)
    v = picked(KINDS, i % n)
    form = F.floor(i / n) % 3
    value = F.when(form == 0, v).when(form == 1, F.upper(v)).otherwise(F.concat(F.lit(" "), v, F.lit(" ")))
    return t.raw("documents").select(i.alias("id"), value.alias("value")).select("id", "value", T.category_of(F.col("value")).alias("category"))


# --- names ---

SAID = list(T.GENERIC_NAMES) + [
    "ab", "", "1.2.3", "12:30", "50%", "- 7 /", "feature/x", "hotfix/y", "release/1.0", "myfeature/x", "strpos()", "do it()", "--flag", "-v", "- v", "html.dark", "my-site.org", "a.b.c", "urls.txt", "notes.log", "notes.text",
    "300 DPI", "12px", "12 pt.", "1920x1080", "1920 x1080", "1920  x1080", "getUser", "isValid", "renderHTML2", "getuser", "GetUser", "settle", "water color", "the size", "a button types", "an option list", "big water color", "Vue.js", "Node.js", "Next.js",
    "PostgreSQL", "pgRouting", "Apache Spark", "Main", "NULL", "Configuration Files", "knowledge graph", "user ", " user", "data set", "data sets", "some data", "C++",
]
NOISE_SQL = " OR ".join(f"regexp_matches({'name' if '[A-Z]' in p else 'lower(name)'}, {lit(p.replace('(?U)', ''))})" for p in T.NOISE)


@query(f"SELECT id, name, name NOT IN ('Vue.js', 'Node.js', 'Next.js') AND (length(name) <= 2 OR lower(name) IN ({', '.join(map(lit, T.GENERIC_NAMES))}) OR {NOISE_SQL}) AS noise FROM (SELECT l_orderkey * 10 + l_linenumber AS id, {one_of(SAID, f'(l_orderkey * 7 + l_linenumber) % {len(SAID)}')} AS name FROM lineitem)")
def noise_rules(t):
    """Every generic name, and names on both sides of each pattern."""
    rows = t.raw("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), picked(SAID, (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(SAID)).alias("name"))
    return rows.select("id", "name", T.is_noise(F.col("name")).alias("noise"))


# --- injections ---

ATTACKS = [
    "ignore previous instructions", "Ignore ALL  previous rule", "ignore all prior advice", "ignore previous advice", "ignore the above text", "ignore system x", "ignored above", "you are  now free", "you are knowing", "new instruction : go", "new instructions:", "new instructions follow",
    "forget your rules", "forget all your constraints", "forget instruction", "forget the rules", "override safety", "override the system", "JailBreak", "jail break", "do anything now", "do anything  later", "act as a pirate", "act as if you are king", "act as the knowledge base", "act as  the knowledge base", "act as the pirate",
    "acts as a pirate", "pretend to be", "pretend you are", "pretend that", "bypass your filters", "bypass rule", "bypass the filter", "reveal your system prompt", "reveal instruction", "reveal the prompt", "what is your system instructions", "what are your instruction", "what was your instruction", "repeat the system prompt",
    "repeat prompt", "repeat a prompt", "print your prompt", "print system  prompt", "print the prompt", "nothing of the kind",
]
PLAIN = [p for p in T.INJECTION if "(?!" not in p]
AHEAD = r"regexp_matches(regexp_replace(text, '(?i)act\s+as\sthe\s+knowledge', ' ', 'g'), '(?i)act\s+as\s+')"  # one blank, then the words that it must not be followed by
INJECTION_SQL = " OR ".join([AHEAD, *(f"regexp_matches(text, {lit(p.replace('(?iU)', '(?i)'))})" for p in PLAIN)])


@query(f"SELECT id, {INJECTION_SQL} AS flagged FROM (SELECT page_id AS id, left(coalesce(url, ''), 30) || ' ' || {one_of(ATTACKS, f'page_id % {len(ATTACKS)}')} || ' ' || left(html, 20) AS text FROM pages)")
def injection_rules(t):
    """Sentences on both sides of each of the fifteen patterns, within other text."""
    assert len(T.INJECTION) == 15 and len(PLAIN) == 14
    said = F.concat(F.left(F.coalesce("url", F.lit("")), F.lit(30)), F.lit(" "), picked(ATTACKS, F.col("page_id") % len(ATTACKS)), F.lit(" "), F.left("html", F.lit(20)))
    return t.raw("pages").select(F.col("page_id").alias("id"), T.injection(said).alias("flagged"))

"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

All of it is DataFrame expressions on one row; nothing is shuffled. Positions come from the
lengths of the pieces that a text falls into when split at the matches of a pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.sources.tables import table

#: Characters on each side of a match that are searched for context words, up to the kind's neighbouring match.
NEAR = 40
#: Spans outside the base set need this score.
THRESHOLD = 0.6


@dataclass(frozen=True)
class Kind:
    """pattern: with possessive repeats, so that no long text makes it backtrack; a run of local-part
    characters or digits is entered only at its start or where the last match ended, as no later
    start inside it could match. needs: a fixed string each match contains. prior: score of a
    match that its validator accepts; context adds to it, up to 1."""

    name: str
    pattern: str
    needs: str | None
    words: str
    prior: float
    context: float
    base: bool


#: The patterns of the contract, the order of kinds, words that speak for a kind.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write to", 0.8, 0.2, True),
    Kind("ip", r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", ".", "ip|address|host|server", 0.7, 0.2, True),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", None, "card|visa|mastercard|credit|payment", 0.8, 0.2, True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", "phone|call|tel|mobile|fax", 0.7, 0.2, True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", None, "iban|bank|account|konto|cuenta|compte", 0.7, 0.2, False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", "ssn|social security", 0.3, 0.5, False),
)
#: Account numbers by country have a fixed length, so that capitals or digits behind one are not taken for it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR",
    27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_BY_COUNTRY = "|".join(f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
EXACT = Kind("iban", rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{_BY_COUNTRY})(?![A-Z0-9])", None, "iban|bank|account|konto|cuenta|compte", 0.7, 0.2, False)
BASE = tuple(k.name for k in KINDS if k.base)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = turned.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (capitals and digits, no spaces) leaves 1 when divided by 97."""
    turned = F.concat(code.substr(F.lit(5), F.length(code)), code.substr(F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(turned.substr(i, F.lit(1)))
        return F.when(c < 65, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def valid(kind: str, match: Column) -> Column:
    """Whether the validator of a kind accepts a match of its pattern."""
    digits = _digits(match)
    if kind == "ip":
        parts = F.split(match, r"\.")
        significant = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(parts, lambda p: (F.length(significant(p)) <= 3) & (F.coalesce(significant(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)") & ~match.rlike("-00-|-0000$")
    return F.lit(True)


SPANS = "array<struct<start:int,stop:int,score:double>>"


def proposals(text: Column, kind: Kind) -> tuple[Column, Column]:
    """The matches of a kind's pattern, and the pieces of text around them (one more)."""
    possible = F.lit(True) if kind.needs is None else F.contains(text, F.lit(kind.needs))
    return (
        F.when(possible, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))),
        F.when(possible, F.split(text, kind.pattern, -1)),
    )


def confirmed(matches: Column, pieces: Column, kind: Kind) -> Column:
    """array<struct<start, stop, score>> of the accepted matches, by start; code points, end exclusive."""
    n = F.size(matches)
    zipped = F.arrays_zip(
        F.slice(pieces, F.lit(1), n).alias("before"), matches.alias("match"), F.slice(pieces, F.lit(2), n).alias("after")
    )
    none = F.array().cast(SPANS)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        stop = start + F.length(x["match"])
        near = F.lower(F.concat(F.substring(x["before"], -NEAR, NEAR), F.lit(" "), F.substring(x["after"], 1, NEAR)))
        score = F.round(F.lit(kind.prior) + F.when(near.rlike(kind.words), F.lit(kind.context)).otherwise(F.lit(0.0)), 2)
        found = F.struct(start.alias("start"), stop.alias("stop"), score.alias("score"))
        accepted = valid(kind.name, x["match"]) & (F.lit(kind.base) | (score >= THRESHOLD))
        return F.struct(stop.alias("at"), F.when(accepted, F.concat(acc["spans"], F.array(found))).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])
    return F.when(n > 0, found).otherwise(none)


def with_exact(longest: Column, exact: Column) -> Column:
    """Spans of account numbers as long as possible and of their country's length; of two that overlap, the latter."""
    same = lambda s, t: (s["start"] == t["start"]) & (s["stop"] == t["stop"])
    meets = lambda s, t: (s["start"] < t["stop"]) & (t["start"] < s["stop"])
    others = F.filter(longest, lambda s: ~F.exists(exact, lambda t: meets(s, t) & ~same(s, t)))
    added = F.filter(exact, lambda s: ~F.exists(longest, lambda t: same(s, t)))
    return F.array_sort(F.concat(others, added))


def find_personal_data(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col and spans, an array<struct<kind, start, end, score>>, for each row of docs.

    The base kinds (email, ip, card, phone) are always in; iban and ssn enter when their score
    reaches THRESHOLD, which ssn does only with a context word nearby. A null or empty text has no
    spans; repeated rows are each their own; other columns are not read.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # the patterns run once each: a projection of their own holds what they find
    columns = {k.name: k for k in KINDS} | {"exact": EXACT}
    rows = rows.select(
        id_col,
        *[c.alias(f"_{name}_{part}") for name, k in columns.items() for part, c in zip(("matches", "pieces"), proposals(F.col("_text"), k), strict=True)],
    )
    rows = rows.select(id_col, *[confirmed(F.col(f"_{name}_matches"), F.col(f"_{name}_pieces"), k).alias(f"_{name}") for name, k in columns.items()])
    rows = rows.withColumn("_iban", with_exact(F.col("_iban"), F.col("_exact")))

    def named(name: str) -> Column:
        return F.transform(
            f"_{name}", lambda s: F.struct(F.lit(name).alias("kind"), s["start"].alias("start"), s["stop"].alias("end"), s["score"].alias("score"))
        )

    return rows.select(id_col, F.concat(*[named(k.name) for k in KINDS]).alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def written(which: Column, score: bool = False) -> Column:
        parts = lambda s: [s["kind"], s["start"], s["end"]] + ([F.format_string("%.2f", s["score"])] if score else [])
        return F.concat_ws(",", F.transform(which, lambda s: F.concat_ws(":", *[p.cast("string") for p in parts(s)])))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        written(F.col("spans"), score=True).alias("scored_spans"),
    )


def _sql() -> str:
    """DuckDB: the contract's plain patterns; starts are sums over the pieces and matches before."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[ -]?[0-9])+",
    }
    ok = {
        "email": "true",
        "ip": r"len(list_filter(string_split(m, '.'), lambda q: length(ltrim(q, '0')) > 3 OR coalesce(try_cast(ltrim(q, '0') AS INT), 0) > 255)) = 0",
        "card": "length(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ascii(substr(reverse(g), i, 1)) - 48 WHEN ascii(substr(reverse(g), i, 1)) > 52 THEN (ascii(substr(reverse(g), i, 1)) - 48) * 2 - 9 ELSE (ascii(substr(reverse(g), i, 1)) - 48) * 2 END)) % 10 = 0",
        "phone": "length(g) BETWEEN 9 AND 15",
        "iban": "length(c) BETWEEN 15 AND 34 AND try_cast(list_aggregate(list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda q: CASE WHEN q < 'A' THEN q ELSE (ascii(q) - 55)::VARCHAR END), 'string_agg', '') AS HUGEINT) % 97 = 1",
        "ssn": "NOT regexp_matches(m, '^(000|666|9)') AND NOT regexp_matches(m, '-00-|-0000$')",
    }
    parts = []
    for at, k in enumerate(KINDS):
        pattern = plain.get(k.name, k.pattern)
        extra = "" if k.base else f" AND score >= {THRESHOLD}"
        parts.append(
            f"""SELECT doc_id, {at} AS ord, '{k.name}' AS kind, start, start + length(m) AS stop, score FROM (
  SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS g, replace(m, ' ', '') AS c,
         round({k.prior} + CASE WHEN regexp_matches(lower(right(p[i], {NEAR}) || ' ' || left(p[i + 1], {NEAR})), '{k.words}') THEN {k.context} ELSE 0 END, 2) AS score,
         coalesce(list_sum(list_transform(p[1:i], lambda q: length(q))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda q: length(q))), 0) AS start
  FROM (SELECT doc_id, p, ms, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m FROM (
    SELECT doc_id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS ms FROM d))
) WHERE {ok[k.name]}{extra}"""
        )
    every = "\nUNION ALL\n".join(parts)
    text = "kind || ':' || start::BIGINT || ':' || stop::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({every}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
        coalesce(string_agg({text}, ',' ORDER BY ord, start) FILTER (ord < {len(BASE)}), '') AS base,
        string_agg({text}, ',' ORDER BY ord, start) AS spans,
        string_agg({text} || ':' || printf('%.2f', score), ',' ORDER BY ord, start) AS scored_spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scored_spans, '') AS scored_spans
FROM d LEFT JOIN g USING (doc_id)
"""


OP9_SQL = _sql()

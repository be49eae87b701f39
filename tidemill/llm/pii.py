"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust a score.

Only DataFrame functions. A pattern's matches come from `regexp_extract_all`, their places from the
lengths of what `split` leaves between them, so each kind costs two passes over a text; running sums
are made by doubling, so that many matches cost little more than few. Patterns start a match only at
the start of a run of their first character class or where the last match ended; a start within the
run can't match if its first character didn't, and long runs stay linear. Possessive groups keep the
matcher's stack flat on long texts.

A span scores by its kind, and more if one of the kind's context words stands within NEAR characters
before or after it, up to the next match. Spans of the kinds that the operator adds count from LEAST
on, so those whose pattern alone says little need their context; those of the base kinds always do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(F.filter(d, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def _card(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)


def _ip(m: Column) -> Column:
    def small(x: Column) -> Column:
        n = F.ltrim(x, F.lit("0"))
        return (F.length(n) < 3) | ((F.length(n) == 3) & (n <= "255"))

    return F.forall(F.split(m, r"\."), small)


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


def _ssn(m: Column) -> Column:
    """Numbers that are never given out: area 000, 666 or from 900 on, group 00, serial 0000."""
    area = F.substring(m, 1, 3)
    return ~area.isin("000", "666") & (area < "900") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")


def _iban(m: Column) -> Column:
    """Mod-97 of the rearranged number, letters as 10 to 35, taken digit by digit."""
    s = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return F.when(F.length(s).between(15, 34), rest == 1).otherwise(False)


@dataclass(frozen=True)
class Kind:
    """`score` in hundredths, without context; `may`: a cheap test that every text with a match passes."""

    name: str
    pattern: str
    confirm: Callable[[Column], Column] | None
    score: int
    context: str
    may: str


#: Base kinds in the order of the digest, then kinds that only the operator adds.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 80, "mail|contact|kontakt|correo|courriel", "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 50, "ip|host|server|address|adresse", "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 60, "card|visa|karte|carte|tarjeta|credit", ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 60, "phone|call|tel|mobile|fax", "+"),
)
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban, 70, "iban|account|konto|compte|cuenta|bank", ""),
    Kind("secret", r"(?<![A-Za-z0-9_])(?:token|secret|password|passwd|api_key|apikey)\x20?[=:]\x20?\"[^\"\n]{8,200}\"", None, 80, "key|secret|auth|login", '"'),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn, 40, "ssn|social|tax|steuer|seguridad|fiscal", "-"),
)
KINDS = BASE + ADDED
NEAR, RAISE, LEAST = 40, 20, 60
_SPAN = "array<struct<kind:string,start:int,end:int,score:int>>"


def _ends(found: Column, gaps: Column) -> Column:
    """Where each match ends: running sums of the lengths of gaps and matches, in a step for each power of two below their number."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda k: k < F.size(found))
    sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    return F.aggregate(steps, sizes, lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - k), F.lit(0))))


def _spans(kind: Kind, found: Column, gaps: Column, ends: Column) -> Column:
    """Array of (kind, start, end, score) of the confirmed matches, in order; offsets in code points, end exclusive."""
    said = rf"(?:^|[^a-z])(?:{kind.context})"

    def span(m: Column, i: Column) -> Column:
        near = F.lower(F.right(F.get(gaps, i), F.lit(NEAR))).rlike(said) | F.lower(F.left(F.get(gaps, i + 1), F.lit(NEAR))).rlike(said)
        score = F.lit(kind.score) + F.when(near, RAISE).otherwise(0)
        sure = kind.confirm(m) if kind.confirm else F.lit(True)
        return F.struct(F.lit(kind.name).alias("kind"), (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), F.when(sure, score).alias("score"))

    return F.filter(F.transform(found, span), lambda x: x["score"] >= (LEAST if kind in ADDED else 0))


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and one array column per kind, named after it; no exchange, every row on its own.

    Null or empty text has no spans, a text of any length is searched whole; a null doc_id stays null,
    rows of the same id each get their own; an empty table stays empty; other columns, whatever their
    names, are not read. Matches of one kind don't overlap, those of different kinds may.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    may = {k: F.contains("text", F.lit(k.may)) if k.may else F.col("text").rlike("[0-9]") for k in kinds}
    # in steps, since what a lambda reads must be a column: an expression would be evaluated for each element
    rows = rows.select("doc_id", *[F.when(may[k], c).alias(f"{k.name}_{n}") for k in kinds for n, c in (("m", F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))), ("g", F.split("text", k.pattern, -1)))])
    rows = rows.select("*", *[_ends(F.col(f"{k.name}_m"), F.col(f"{k.name}_g")).alias(f"{k.name}_e") for k in kinds])
    return rows.select("doc_id", *[F.coalesce(_spans(k, *(F.col(f"{k.name}_{n}") for n in "mge")), F.array().cast(_SPAN)).alias(k.name) for k in kinds])


def joined(*kinds: str) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    return F.array_join(F.transform(F.concat(*[F.col(k) for k in kinds]), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in `documents`: counts, a digest of the base spans, all spans, their number and scores."""
    found = find_pii(common.table(spark, sf_dir, "documents"))
    base, every = [k.name for k in BASE], [k.name for k in KINDS]
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(*base), 256).alias("base_sha256"),
        joined(*every).alias("spans"),
        sum((F.size(k) for k in every[1:]), F.size(every[0])).cast("long").alias("n_pii"),
        F.array_join(F.transform(F.concat(*every), lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def _sql_kind(name: str, pattern: str, keep: str) -> str:
    kind = next(k for k in KINDS if k.name == name)
    said = f"(?:^|[^a-z])(?:{kind.context})"
    return f"""
{name}_m AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM d),
{name}_r AS (SELECT doc_id, i, m[i] AS s, g[i] AS before, g[i+1] AS after, sum(length(g[i]) + CASE WHEN i > 1 THEN length(m[i-1]) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS a
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM {name}_m WHERE len(m) > 0)),
{name}_c AS (SELECT *, {kind.score} + CASE WHEN regexp_matches(lower(right(before, {NEAR})), '{said}') OR regexp_matches(lower(left(after, {NEAR})), '{said}') THEN {RAISE} ELSE 0 END AS score FROM {name}_r),
{name}_k AS (SELECT doc_id, '{name}' AS kind, CAST(a AS BIGINT) AS a, CAST(a + length(s) AS BIGINT) AS b, score FROM {name}_c WHERE {keep} AND score >= {LEAST if kind in ADDED else 0})"""


_LUHN = r"length(regexp_replace(s,'[^0-9]','','g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(regexp_replace(s,'[^0-9]','','g'))+1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(reverse(regexp_replace(s,'[^0-9]','','g'))[j] AS INT) ELSE CAST(reverse(regexp_replace(s,'[^0-9]','','g'))[j] AS INT)*2 - CASE WHEN CAST(reverse(regexp_replace(s,'[^0-9]','','g'))[j] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_MOD97 = r"length(replace(s,' ','')) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(substr(replace(s,' ',''),5) || substr(replace(s,' ',''),1,4), ''), lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda x, y: CASE WHEN y < 10 THEN (x*10+y) % 97 ELSE (x*100+y) % 97 END, 0) = 1"
ORACLE_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text,'') AS t FROM documents),"
    + ",".join((
        _sql_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        _sql_kind("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(s,'.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0"),
        _sql_kind("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
        _sql_kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(s,'[^0-9]','','g')) BETWEEN 9 AND 15"),
        _sql_kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", _MOD97),
        _sql_kind("secret", r"\b(?:token|secret|password|passwd|api_key|apikey)\x20?[=:]\x20?\"[^\"\n]{8,200}\"", "true"),
        _sql_kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "left(right(before, 1), 1) <> '-' AND left(after, 1) <> '-' AND left(s, 3) NOT IN ('000', '666') AND left(s, 3) < '900' AND substr(s, 5, 2) <> '00' AND right(s, 4) <> '0000'"),
    ))
    + ",\na AS ("
    + " UNION ALL ".join(f"SELECT *, {i} AS o FROM {k.name}_k" for i, k in enumerate(KINDS, 1))
    + """),
s AS (SELECT doc_id, count(*) FILTER (o=1) e, count(*) FILTER (o=2) i, count(*) FILTER (o=3) c, count(*) FILTER (o=4) p, count(*) AS n,
 string_agg(kind||':'||a||':'||b, ',' ORDER BY o, a) FILTER (o <= 4) base, string_agg(kind||':'||a||':'||b, ',' ORDER BY o, a) al, string_agg(score, ',' ORDER BY o, a) sc FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(e,0) AS n_email, coalesce(i,0) AS n_ip, coalesce(c,0) AS n_card, coalesce(p,0) AS n_phone,
 sha256(coalesce(base,'')) AS base_sha256, coalesce(al,'') AS spans, coalesce(n,0) AS n_pii, coalesce(sc,'') AS scores FROM d LEFT JOIN s USING (doc_id)"""
)

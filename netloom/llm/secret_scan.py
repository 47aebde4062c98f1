"""Secret scan that links the parts of a credential, all in built-in functions.

Strong kinds (``assign``, ``access``, ``hex``) are always reported. Weak kinds are reported only where the
parts that complete them stand within ``SCOPE`` characters: a named identifier needs a secret, a token
of base-64 characters needs an identifier, an endpoint needs both. Weak spans that overlap a strong
one are part of it and not reported. Parts meet in an interval join on (document, cell of text), so
its work follows the length of the text, however many parts a document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut

SCOPE = 200
CELL = 512


def _either(word: str) -> str:
    """``word`` in letters of either case, ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
_NAMES = "|".join(map(_either, ("access_?key_?id", "client_?id", "username", "user", "login", "account")))

#: kind, pattern, group whose length counts, least length, strong, role
KINDS = (
    ("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, "secret"),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, True, "identifier"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, True, "secret"),
    ("ident", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""", 2, 3, False, "identifier"),
    ("blob", r"[A-Za-z0-9+/]{32,}={0,2}", 0, 32, False, "secret"),
    ("endpoint", r"https?://[A-Za-z0-9._:-]+[A-Za-z0-9/_-]", 0, 12, False, "endpoint"),
)


def _found(text: Column, pattern: str, group: int) -> Column:
    """For every match, left to right: the characters since the match before, its size, and the size of a group."""
    sizes = lambda x: F.transform(x, lambda s: F.length(s))
    literal = F.lit(pattern)
    gaps = sizes(F.split(text, pattern, -1))
    return F.when(
        text.rlike(pattern),
        F.arrays_zip(
            gaps.alias("gap"),
            sizes(F.regexp_extract_all(text, literal, F.lit(0))).alias("size"),
            sizes(F.regexp_extract_all(text, literal, F.lit(group))).alias("value"),
        ),
    )


def _parts(scanned: DataFrame) -> DataFrame:
    """``(_row, kind, strong, role, start, stop)`` of every match that is long enough; code points, end exclusive."""
    kinds = F.array(*[
        F.struct(F.lit(i).alias("kind"), F.lit(least).alias("least"), F.lit(strong).alias("strong"), F.lit(role).alias("role"), F.col(name).alias("found"))
        for i, (name, _, _, least, strong, role) in enumerate(KINDS)
    ])
    each = scanned.select("_row", F.inline(kinds)).where("found is not null")
    rows = each.select("_row", "kind", "least", "strong", "role", F.posexplode("found").alias("at", "m")).where("m.size is not null")
    # a running sum inside one kind of one document
    placed = rows.withColumn("stop", F.expr("sum(m.gap + m.size) over (partition by _row, kind order by at)"))
    return placed.where("m.value >= least").select("_row", "kind", "strong", "role", (F.col("stop") - F.col("m.size")).alias("start"), "stop")


def _cells(start: Column, stop: Column) -> Column:
    return F.explode(F.sequence((start / CELL).cast("long"), (stop / CELL).cast("long"))).alias("cell")


def _linked(parts: DataFrame) -> DataFrame:
    """Weak parts whose complements stand within the scope."""
    weak = parts.where("not strong")
    reach = weak.select("_row", "kind", "role", "start", "stop", _cells(F.greatest(F.col("start") - SCOPE, F.lit(0)), F.col("stop") + SCOPE))
    near = parts.select(
        "_row", F.col("kind").alias("k"), F.col("strong").alias("s"), F.col("role").alias("r"),
        F.col("start").alias("a"), F.col("stop").alias("b"), _cells(F.col("start"), F.col("stop")),
    )
    met = reach.join(near, ["_row", "cell"]).where(f"a < stop + {SCOPE} and start < b + {SCOPE} and (k <> kind or a <> start)")
    touches = F.expr("a < stop and start < b")
    judged = met.groupBy("_row", "kind", "role", "start", "stop").agg(
        F.max(touches & F.col("s")).alias("inside"),
        F.max((F.col("r") == "identifier") & ~touches).alias("has_identifier"),
        F.max((F.col("r") == "secret") & ~touches).alias("has_secret"),
    )
    complete = F.expr(
        "not inside and case role when 'identifier' then has_secret when 'secret' then has_identifier else has_identifier and has_secret end"
    )
    return judged.where(complete).select("_row", "kind", "start", "stop")


def secret_scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row of ``docs``.

    ``spans`` lists ``kind:start:end`` by start, then kind in the order of ``KINDS``, joined by commas; ``base_sha256`` is the
    SHA-256 of the same list of the strong kinds alone. Null and empty texts have none: counts of 0, an empty list. Rows
    are told apart by position, so repeated rows and null ids each get a row; other columns are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("_row"))
    scanned = cut(rows.select("doc_id", "_row", *[_found(F.col("text"), pattern, group).alias(name) for name, pattern, group, *_ in KINDS]))
    parts = cut(_parts(scanned))
    reported = parts.where("strong").select("_row", "kind", "start", "stop").unionByName(_linked(parts))
    found = reported.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("all"))
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    written = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ","
    )
    count = lambda kind: F.size(F.filter("all", lambda x: x["kind"] == kind)).cast("long")
    told = found.select(
        "_row", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        written(F.filter("all", lambda x: x["kind"] < 3)).alias("_base"), written(F.col("all")).alias("spans"),
    )
    whole = scanned.select("doc_id", "_row").join(told, "_row", "left").na.fill(0, ["n_assign", "n_access", "n_hex"])
    return whole.na.fill("", ["_base", "spans"]).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("_base").cast("binary"), 256).alias("base_sha256"), "spans"
    )


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS kind, {least} AS least, {strong} AS strong, '{role}' AS role,
        unnest(list_transform(regexp_extract_all(text, {quote(p)}), lambda x: length(x))) AS size,
        unnest(list_transform(regexp_extract_all(text, {quote(p)}, {group}), lambda x: length(x))) AS value,
        unnest(list_transform(regexp_split_to_array(text, {quote(p)})[:-2], lambda x: length(x))) AS gap,
        generate_subscripts(regexp_extract_all(text, {quote(p)}), 1) AS pos
        FROM t WHERE regexp_matches(text, {quote(p)})"""
        for i, (_, p, group, least, strong, role) in enumerate(KINDS)
    )
    names = "[" + ", ".join(f"'{k[0]}'" for k in KINDS) + "]"
    listed = f"string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({each}),
    placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS stop FROM m),
    part AS (SELECT doc_id, kind, strong, role, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE value >= least),
    met AS (SELECT w.*, p.role AS r, w.start < p.stop AND p.start < w.stop AS touches, p.strong AS s FROM part w JOIN part p ON w.doc_id = p.doc_id
      AND p.start < w.stop + {SCOPE} AND w.start < p.stop + {SCOPE} AND (w.kind <> p.kind OR w.start <> p.start) WHERE NOT w.strong),
    judged AS (SELECT doc_id, kind, role, start, stop, bool_or(touches AND s) AS inside, bool_or(r = 'identifier' AND NOT touches) AS i,
      bool_or(r = 'secret' AND NOT touches) AS c FROM met GROUP BY ALL),
    reported AS (SELECT doc_id, kind, start, stop FROM part WHERE strong UNION ALL SELECT doc_id, kind, start, stop FROM judged
      WHERE NOT inside AND CASE role WHEN 'identifier' THEN c WHEN 'secret' THEN i ELSE i AND c END),
    told AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
      {listed} FILTER (kind < 3) AS base, {listed} AS spans FROM reported GROUP BY doc_id)
    SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN told USING (doc_id)"""


SQL = _sql()

"""Secret scans with corpus-wide ownership frequency. DataFrame operations only.

Every candidate's value is hashed and its hash counted over distinct repositories and owners: a value that many owners
have is a copied example, one that stays with its owner and doesn't read like a placeholder looks live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstruct.llm.scratch import stage
from docstruct.llm.textbatch import Carried, column


@dataclass(frozen=True)
class Kind:
    """pattern: regular expression without groups of its own but the `group`-th, which is the value (0: all); least: characters of the value; hints: texts without any of these have no match (letters in either case if `any_case`)."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool
    hints: tuple[str, ...] = ()
    any_case: bool = False


#: In this order they rank at one start. Patterns of providers' key formats as their public documents give them.
#: access and hex ask for their least length at once: their matches are whole runs, so that the others would be dropped anyhow.
#: A private key's value goes on through its body, which tells one key from another; a header without a body is none.
KINDS = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, True, ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True, ("AKIA",)),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Kind("provider", r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|[rs]k_live_[A-Za-z0-9]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[\x20\x09-\x0D]*[A-Za-z0-9+/=]{16,}[A-Za-z0-9+/=\x20\x09-\x0D]*", 0, 10, False, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "k_live_", "eyJ", "-----BEGIN ")),
    Kind("url", r"[a-z][a-z0-9+]{1,9}://[A-Za-z0-9._-]+:([^\x20\x09-\x0D:/@]+)@", 1, 4, False, ("://",)),
)
#: Distinct owners from which a value counts as a copied example.
SHARED_OWNERS = 3
#: A value looks live if it has so many different characters and a digit, and none of the words of placeholders.
LIVE_CHARS, PLACEHOLDERS = 6, r"(?i:example|sample|dummy|changeme|placeholder|redacted|xxxx|your)"
_NONE = "CAST(array() AS array<struct<rank:int,i:int,gap:int,size:int,value_sha256:string,varied:boolean>>)"


def _may_have(body: Column, low: Column, kind: Kind) -> Column:
    """Whether the kind can have a match that passes: a cheap test before its expression runs."""
    if not kind.hints:
        return body.rlike(kind.pattern)
    return F.coalesce(*(F.when(F.contains(low if kind.any_case else body, F.lit(h)), F.lit(True)) for h in kind.hints), F.lit(False))


def varied(value: Column) -> Column:
    """Whether the value is of many characters, has a digit, and reads like no placeholder."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARS) & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDERS)


def matches(body: Column, kinds: tuple[Kind, ...] = KINDS) -> tuple[dict[str, Column], Column]:
    """Columns of the matches m, and of the texts p between them, of each kind, and the array of (rank, i, gap, size, value_sha256, varied) built of them.

    Spark tells no positions of matches, so each match carries its size and that of the gap before it; their running sums
    are the positions. value_sha256 is null where the value is too short. m and p are zipped before a lambda sees them, else
    they would be computed anew for each element.
    """
    low, raw, found = F.lower(body), {}, []
    for rank, k in enumerate(kinds):
        has = _may_have(body, low, k)
        raw |= {f"_m{rank}": F.when(has, F.regexp_extract_all(body, F.lit(f"({k.pattern})"), F.lit(1))), f"_p{rank}": F.when(has, F.split(body, k.pattern, -1))}
        found.append(F.coalesce(_described(f"_m{rank}", f"_p{rank}", rank, k), F.expr(_NONE)))
    return raw, F.concat(*found)


def _described(matches: str, gaps: str, rank: int, kind: Kind) -> Column:
    def one(x: Column, i: Column) -> Column:
        value = F.regexp_extract(x[matches], kind.pattern, kind.group)
        long = F.length(value) >= kind.least
        return F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.length(x[gaps]).alias("gap"), F.length(x[matches]).alias("size"), F.when(long, F.sha2(value, 256)).alias("value_sha256"), F.when(long, varied(value)).alias("varied"))

    pairs = F.filter(F.arrays_zip(matches, gaps), lambda x: x[matches].isNotNull())  # the text behind the last match has none
    return F.transform(pairs, one)


def spans(each: DataFrame) -> DataFrame:
    """(_row, start, end, rank, value_sha256, varied) of the passing matches of rows (_row, x): running sums of gaps and sizes within a row and kind, linear in the matches."""
    flat = each.select("_row", "x.*")
    ran = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("_row", "rank").orderBy("i"))
    placed = flat.withColumn("end", ran.cast("int")).where("value_sha256 IS NOT NULL")
    return placed.select("_row", (F.col("end") - F.col("size")).alias("start"), "rank", "end", "value_sha256", "varied")


def ownership(candidates: DataFrame, value: str, owner: str, repo: str) -> DataFrame:
    """(value, owners, repos): distinct owners and distinct (owner, repo) of each value. Null owners and repositories count as one.

    Deals by all three keys first; what is then summed by value has been counted on each task before.
    """
    pairs = candidates.select(value, owner, repo).distinct().groupBy(value, owner).agg(F.count("*").alias("_n"))
    return pairs.groupBy(value).agg(F.count("*").alias("owners"), F.sum("_n").alias("repos"))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id", keep: list[str] | None = None, kinds: tuple[Kind, ...] = KINDS, shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """Add found to the columns `keep` of docs (None: all): an array of (start, rank, end, kind, value_sha256, owners, repos, live) by start and rank.

    Positions are code points, end exclusive; values leave only as digests. Spans of base kinds all stay; those of other
    kinds stay if their value looks live: fewer owners than shared_owners, and varied. Null and empty texts have none;
    null owners are one owner; repeated rows have the same spans each; a column named found is replaced, whatever its
    case; an empty table gives an empty result. The scan is written once with a row number, which makes repeated rows and
    null ids tell apart; only candidates are shuffled, a hot value split by adaptive execution.
    """
    own = Carried(docs, keep, ("found",))
    rows = docs.select(*own.into(), column(owner).cast("string").alias("_owner"), column(repo).cast("string").alias("_repo"), F.coalesce(column(text), F.lit("")).alias("_text"))
    raw, found = matches(F.col("_text"), kinds)
    scanned = stage(rows.withColumns(raw).select(*own.inner, "_owner", "_repo", found.alias("_found"), F.monotonically_increasing_id().alias("_row")), "scan")
    some = scanned.where(F.size("_found") > 0)
    placed = stage(spans(some.select("_row", F.explode("_found").alias("x"))), "spans")
    owned = placed.join(some.select("_row", "_owner", "_repo"), "_row")
    counts = stage(ownership(owned, "value_sha256", "_owner", "_repo"), "ownership")
    base = [i for i, k in enumerate(kinds) if k.base]
    judged = placed.join(counts, "value_sha256").withColumn("live", (F.col("owners") < shared_owners) & F.col("varied"))
    named = judged.withColumn("kind", F.element_at(F.array(*(F.lit(k.name) for k in kinds)), F.col("rank") + 1)).where(F.col("live") | F.col("rank").isin(*base))
    back = named.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind", "value_sha256", "owners", "repos", "live"))).alias("found"))
    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string,value_sha256:string,owners:bigint,repos:bigint,live:boolean>>)")
    return scanned.join(back, "_row", "left").select(*own.back(), F.coalesce("found", none).alias("found"))


def digest(found: Column, only: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    some = found if only is None else F.filter(found, lambda x: x["kind"].isin(*only))
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _oracle() -> str:
    whole = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}  # as the contract states them
    parts = []
    for i, k in enumerate(KINDS):
        pattern = whole.get(k.name, k.pattern)
        shape = f"({pattern})".replace("'", "''")
        bare = pattern.replace("'", "''")
        parts.append(f"""SELECT id, doc_id, source, {i} AS rank, '{k.name}' AS kind, m, v, coalesce(sum(length(p) + length(m)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(p) AS start
  FROM (SELECT id, doc_id, source, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(ps[1:len(ms)]) AS p
        FROM (SELECT id, doc_id, source, regexp_extract_all(t, '{shape}', 1) AS ms, regexp_extract_all(t, '{shape}', {1 + k.group}) AS vs, string_split_regex(t, '{bare}') AS ps FROM d))
  WHERE true QUALIFY length(v) >= {k.least}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS t FROM documents),
c AS ({" UNION ALL ".join(f"({p})" for p in parts)}),
o AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners FROM c GROUP BY v),
r AS (SELECT c.*, owners < {SHARED_OWNERS} AND len(list_distinct(string_split(v, ''))) >= {LIVE_CHARS} AND regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, '{PLACEHOLDERS}') AS live FROM c JOIN o USING (v)),
k AS (SELECT r.*, rank < 3 AS base, kind || ':' || start::BIGINT || ':' || (start + length(m))::BIGINT AS x
      FROM r WHERE rank < 3 OR live),
a AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(x, ',' ORDER BY start, rank) FILTER (base) AS b, string_agg(x, ',' ORDER BY start, rank) AS spans, count(*) FILTER (live) AS n_live FROM k GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live
FROM d LEFT JOIN a USING (id)
"""


ORACLE_SQL = _oracle()

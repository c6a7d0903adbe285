"""Secret scans over a trigram inverted index.  DataFrame functions only."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as code
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprism.llm.arrays import with_matches
from colprism.llm.shared import narrowed


@dataclass(frozen=True)
class Rule:
    """``least``: code points that ``group`` of a match has at least; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base rules.
BASE_RULES = [
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, base=True),
    # [0-9a-f]+ of 24 or more; runs are maximal, so the shorter ones need not be listed.
    Rule("hex", r"[0-9a-f]{24,}", base=True),
]
#: Further rules, all with a fixed start.
MORE_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
]
RULES = [*BASE_RULES, *MORE_RULES]
_MOST_STRINGS = 64
#: Documents in one posting list.
POSTINGS = 1 << 16


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Trigrams, in lower case, that every match holds: any of the sets, all of its trigrams.

    [frozenset()] says that nothing is mandatory.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(run: set[str]) -> set[str]:
        if all(len(s) >= 3 for s in run):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append([s for s in sets if not any(other < s for other in sets)])
        return {""}

    def exact(items) -> set[str] | None:
        """All strings the items match, if these are few."""
        run = {""}
        for op, arg in items:
            step = strings(op, arg)
            if step is None or len(run) * len(step) > _MOST_STRINGS:
                return None
            run = {a + b for a in run for b in step}
        return run

    def strings(op, arg) -> set[str] | None:
        if op is code.LITERAL:
            return {chr(arg).lower()}
        if op is code.IN and all(o is code.LITERAL for o, _ in arg):
            return {chr(c).lower() for _, c in arg}
        if op is code.SUBPATTERN:
            return exact(arg[-1])
        if op is code.BRANCH:
            parts = [exact(b) for b in arg[1]]
            return None if None in parts else set(itertools.chain(*parts))
        if op is code.MAX_REPEAT and arg[1] == 1:
            inner = exact(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def walk(items, run: set[str]) -> set[str]:
        for op, arg in items:
            step = strings(op, arg)
            if step is not None and len(run) * len(step) <= _MOST_STRINGS:
                run = {a + b for a in run for b in step}
            elif op is code.SUBPATTERN:
                run = walk(arg[-1], run)
            else:
                run = close(run)
                if op is code.MAX_REPEAT and arg[0] >= 1:
                    run = close(walk(arg[2], {""}))
        return run

    close(walk(parser.parse(pattern), {""}))
    query = [frozenset()]
    for clause in clauses:
        if len(query) * len(clause) <= _MOST_STRINGS:
            query = [a | b for a in query for b in clause]
    return query


def postings(docs: DataFrame, trigrams: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """trigram, block, ids: the inverted index for the trigrams that some rule asks for.

    A block is up to ``POSTINGS`` neighbouring rows of one split, so no list grows with
    the table, and lists of one block meet in one place.
    """
    rows = narrowed(docs, id=id, text=text).select("id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    rows = rows.select("id", held.alias("held"), F.floor(F.monotonically_increasing_id() / POSTINGS).alias("block"))
    return rows.select("id", "block", F.explode("held").alias("trigram")).groupBy("block", "trigram").agg(
        F.collect_set("id").alias("ids")
    )


def _tagged(ids: Column, kind: str) -> Column:
    return F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(kind).alias("kind")))


def candidates(docs: DataFrame, rules: list[Rule], id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, kinds: the rules whose trigram queries the postings of a document satisfy."""
    queries = {r.kind: q for r in rules if frozenset() not in (q := trigram_query(r.pattern))}
    trigrams = sorted(set().union(*[s for q in queries.values() for s in q]))
    if not trigrams:
        empty = narrowed(docs, id=id).limit(0)
        return empty.select("id", F.array().cast("array<string>").alias("kinds"))
    index = postings(docs, trigrams, id, text)
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))

    def listed(t: str) -> Column:
        kind = lists.schema["lists"].dataType.valueType.simpleString()
        return F.coalesce(F.try_element_at("lists", F.lit(t)), F.array().cast(kind))

    found = []
    for kind, query in queries.items():
        parts = []
        for need in query:
            part = None
            for t in sorted(need):
                part = listed(t) if part is None else F.array_intersect(part, listed(t))
            parts.append(part)
        whole = parts[0]
        for part in parts[1:]:
            whole = F.array_union(whole, part)
        found.append(_tagged(whole, kind))
    hits = lists.select(F.explode(F.flatten(F.array(*found))).alias("hit"))
    return hits.groupBy(F.col("hit.id").alias("id")).agg(F.collect_set("hit.kind").alias("kinds"))


def _spans(matches: str, rule: Rule, rank: int) -> Column:
    long = F.filter(matches, lambda m: F.length(m["part"]) >= rule.least)
    return F.transform(
        long,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(rule.kind).alias("kind"),
            m["end"].alias("end"),
            m["found"].alias("found"),
            F.lit(rule.base).alias("base"),
        ),
    )


def find_secrets(
    docs: DataFrame, rules: list[Rule] = RULES, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """id, spans: array<struct<start, rank, kind, end, found, base>> by start, then rule.

    One row per row of ``docs``; a null text has no spans.  Starts and ends count code
    points, ends exclusive.  A rule whose regex has mandatory trigrams is tried on the
    documents that the index gives for them, any other rule on all.  Rows with equal ids
    share their candidates and are scanned one by one, so their spans are their own; rows
    without an id are not in the index and are tried by every rule.
    """
    scanned = {r.kind for r in rules if frozenset() in trigram_query(r.pattern)}
    hits = candidates(docs, rules, id, text)
    rows = narrowed(docs, id=id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    hits = hits.select(F.col("id").alias("hit"), "kinds")
    rows = rows.join(hits, rows["id"].eqNullSafe(hits["hit"]), "left")
    nothing = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,found:string,base:boolean>>")
    wanted = {}
    for rank, rule in enumerate(rules):
        here = F.lit(True) if rule.kind in scanned else F.col("id").isNull() | F.array_contains("kinds", rule.kind)
        wanted[f"r{rank}"] = (rule.pattern, rule.group, here)
    rows = with_matches(rows, "text", wanted)
    lists = [F.coalesce(_spans(f"r{rank}", rule, rank), nothing) for rank, rule in enumerate(rules)]
    return rows.select(F.col("id").alias(id), F.sort_array(F.flatten(F.array(*lists))).alias("spans"))


def summary(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts, digest and text form of the spans of ``find_secrets``."""
    written = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.transform(
        F.filter("spans", lambda s: s["base"]),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        id,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(written, ",").alias("spans"),
    )

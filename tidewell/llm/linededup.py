r"""Line dedup by a log-template tree, in DataFrame operations only.

Lines are parsed as a fixed-depth tree parses log messages: fields that hold a
digit become ``<*>``; the first level is the number of tokens, the next DEPTH
levels are the leading tokens; these make a leaf.  In a leaf that enough
documents reach, a token that enough documents have at its position is constant
and any other one is a variable field, ``<*>`` too.  The best supported set of
constants of a leaf, at least SIMILAR of a line's tokens, is a template; lines
that agree with it on SIMILAR of their tokens belong to it, so each may have
its field at another position; the sets left over make further templates.  A
template that occurs in LEAST_DOCUMENTS different texts or more, or one of more
than LONG_TOKENS tokens in LEAST_LONG texts or more, is boilerplate: its lines, and those of other leaves (a field among the leading tokens) that
agree with it so, are dropped from every document but the first (the least
doc_id), so no passage leaves the corpus altogether.

Agreement is by position, so lines differ in words, not in their number.  A
template must recur in one leaf to be found.  Blanks and tabs part tokens.

Copies of a whole text count once, so a copied document is not boilerplate by
itself.  Leaves are counted first, so that only lines of leaves that recur are
masked and kept; tokens are exploded for distinct lines only: a line in a third
of all documents is one row there.

Defined results: null text stays null and has no lines; blank lines are kept
and never counted; lines of fewer than LEAST_TOKENS tokens are kept; repeated
rows count once and lose the same lines; a null doc_id comes last, so its lines
go first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.workspace import free_name, settled

#: Leading tokens that lead to a leaf.
DEPTH = 3
#: Share of constant tokens of a template.
SIMILAR = 0.7
#: Different texts in which a template is boilerplate.
LEAST_DOCUMENTS = 5
#: Lines of more tokens than this are boilerplate in LEAST_LONG different texts.
LONG_TOKENS = 50
LEAST_LONG = 2
LEAST_TOKENS = 4
#: A line of LEAST_TOKENS tokens or more: read no further than its last needed token.
ENOUGH_TOKENS = "^ *+" + "[^ ]++ ++" * (LEAST_TOKENS - 1) + "[^ ]"
#: Leaves up to this many are broadcast (8 bytes each).
BROADCAST_LEAVES = 1_000_000
#: Templates up to this many are broadcast with the hashes of their tokens.
BROADCAST_TEMPLATES = 50_000
#: Leaves with up to this many distinct lines are looked at as one row; in larger ones each token meets the constants by itself.
GATHERED_SHAPES = 32
#: Leaves with up to this many sets left are gone through one set after another within a row; larger ones take rounds.
FOLDED_SETS = 100
#: Runs of templates up to this many are broadcast, as one list for each bucket of some RUNS_OF_BUCKET.
BROADCAST_RUNS = 2_000_000
RUNS_OF_BUCKET = 8
WILDCARD = "<*>"


def masked(line: Column) -> Column:
    """The line, its tokens with a digit as WILDCARD."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", WILDCARD)).otherwise(line)


def blanks_hide_tokens(head: Column) -> Column:
    """Blanks in a row, in front or at the end: fewer tokens than the blanks tell."""
    return F.startswith(head, F.lit(" ")) | F.contains(head, F.lit("  ")) | F.endswith(head, F.lit(" "))


def has_enough_tokens(line: Column) -> Column:
    """LEAST_TOKENS tokens or more; mostly told by the first blanks."""
    odd = blanks_hide_tokens(F.substring_index(line, " ", LEAST_TOKENS))
    return F.when(odd, line.rlike(ENOUGH_TOKENS)).otherwise(F.substring_index(line, " ", LEAST_TOKENS - 1) != line)


def lead_of(line: Column) -> Column:
    """Hash of the masked leading tokens of a line, told without splitting the line; as ``lead_of_tokens``."""
    head = F.substring_index(line, " ", DEPTH)
    single = F.regexp_replace(F.regexp_replace(line, "^ +", ""), " ++", " ")
    return lead_of_tokens(F.split(F.when(blanks_hide_tokens(head), F.substring_index(single, " ", DEPTH)).otherwise(head), " "))


def lead_of_tokens(tokens: Column) -> Column:
    """Hash of the masked leading tokens."""
    leading = (F.get(tokens, F.lit(i)) for i in range(DEPTH))
    return F.xxhash64(F.array(*(F.when(t.rlike("[0-9]"), WILDCARD).otherwise(t) for t in leading)))


def document_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", mask: bool = False, leads: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (of the text), line_no, tokens (split at blanks and tabs), leaf: the lines with LEAST_TOKENS tokens or more.

    With ``mask``, tokens with a digit are WILDCARD.  With ``leads`` (lead,
    broadcast), only lines of such leading tokens; others are not split.
    """
    # the digest comes before the lines are dealt out, so a text is hashed once, and a line is split once, after the filter
    texts = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("digest"), F.split(F.replace(F.col(text), F.lit("\t"), F.lit(" ")), "\n", -1).alias("lines"))
    lines = texts.select("doc_id", "digest", F.posexplode_outer("lines").alias("line_no", "line")).where(has_enough_tokens(F.col("line")))
    if leads is not None:
        lines = lines.withColumn("lead", lead_of(F.col("line"))).join(F.broadcast(leads), "lead", "left_semi")
    line = masked(F.col("line")) if mask else F.col("line")
    tokens = lines.select("doc_id", "digest", "line_no", F.array_remove(F.split(line, " "), "").alias("tokens"))
    leading = (F.get("tokens", F.lit(i)) for i in range(DEPTH))
    return tokens.withColumn("leaf", F.xxhash64(F.size("tokens"), F.array(*(F.when(t.rlike("[0-9]"), WILDCARD).otherwise(t) for t in leading))))


def lines_of_leaves(lines: DataFrame, leaves: DataFrame, broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """The lines (masked) of those leaves, with their shape (a hash of the masked line).

    Up to ``broadcast_leaves`` leaves are broadcast, so the texts stay where they
    are; more are met by a shuffle of the lines.
    """
    if leaves.limit(broadcast_leaves + 1).count() <= broadcast_leaves:
        leaves = F.broadcast(leaves)
    return lines.join(leaves, "leaf", "left_semi").withColumn("shape", F.xxhash64("tokens"))


def enough_texts(n_tokens: Column, least_documents: int = LEAST_DOCUMENTS) -> Column:
    """Different texts in which a template of so many tokens is boilerplate."""
    return F.when(n_tokens > LONG_TOKENS, min(LEAST_LONG, least_documents)).otherwise(least_documents)


def marks_of(tokens: Column) -> Column:
    """One hash for each position and its token."""
    return F.transform(tokens, lambda t, p: F.xxhash64(p, t))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast, if it has up to ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def constant_sets(known: DataFrame, least_documents: int = LEAST_DOCUMENTS, similar: float = SIMILAR) -> DataFrame:
    """leaf, shape, texts, n_tokens, tokens (null where variable), marks, set (a hash of leaf and marks): masked lines with enough constants."""
    # one row for each distinct masked line
    distinct = settled(known.groupBy("leaf", "shape", "tokens").agg(F.countDistinct("digest").alias("texts")), "shapes")
    crowded = distinct.groupBy("leaf").count().where(F.col("count") > GATHERED_SHAPES).select("leaf")
    crowded = small(settled(crowded, "crowded"), BROADCAST_LEAVES)
    enough = lambda support, n_tokens: support >= enough_texts(n_tokens, least_documents)

    # the few lines of a leaf meet in one row, and each of their tokens sums the texts that have it at its position
    gathered = distinct.join(crowded, "leaf", "left_anti").groupBy("leaf").agg(F.collect_list(F.struct("shape", "texts", "tokens")).alias("its"))
    one = gathered.select("leaf", "its", F.explode("its").alias("one")).withColumn("n_tokens", F.size("one.tokens"))
    texts_with = lambda t, p: F.aggregate("its", F.lit(0).cast("long"), lambda n, x: n + F.when(F.get(x["tokens"], p) == t, x["texts"]).otherwise(0))
    token = F.transform("one.tokens", lambda t, p: F.when((t != WILDCARD) & enough(texts_with(t, p), F.col("n_tokens")), t))
    whole = one.select("leaf", "one.shape", "one.texts", "n_tokens", token.alias("tokens"))

    if not crowded.isEmpty():
        placed = distinct.join(crowded, "leaf").select("leaf", "shape", "texts", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("pos", "token"))
        support = placed.groupBy("leaf", "n_tokens", "pos", "token").agg(F.sum("texts").alias("support"))
        constants = support.where(enough(F.col("support"), F.col("n_tokens")))
        known_here = placed.join(constants, ["leaf", "n_tokens", "pos", "token"], "left")
        # a token stays where it is constant, so the collected positions are the set in order
        token = F.when(F.col("support").isNotNull() & (F.col("token") != WILDCARD), F.col("token")).alias("token")
        met = known_here.groupBy("leaf", "shape", "texts", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", token))).alias("at"))
        whole = whole.unionByName(met.select("leaf", "shape", "texts", "n_tokens", F.col("at.token").alias("tokens")))
    marks = whole.withColumn("marks", F.array_compact(F.transform("tokens", lambda t, p: F.when(t.isNotNull(), F.xxhash64(p, t)))))
    return marks.where(F.size("marks") >= similar * F.col("n_tokens")).select(
        "leaf", "shape", "texts", "n_tokens", "tokens", "marks", F.xxhash64("leaf", "marks").alias("set")
    )


def keys_of_sets(n_tokens: Column, tokens: Column, leaf: Column, similar: float = SIMILAR) -> Column:
    """Hashes of the runs of a set without its leading tokens: sets of a leaf that agree share one of them.

    The leading tokens of a leaf are the same in all its sets, so they tell none
    apart; variable ones differ in all of them and use up what may differ.
    """
    leading = F.slice(tokens, 1, DEPTH)
    may_differ = n_tokens - F.ceil(similar * n_tokens) - F.size(F.filter(leading, F.isnull))
    n_runs = F.greatest(may_differ + 1, F.lit(1))
    at = lambda i: F.floor(i * (n_tokens - DEPTH) / n_runs).cast("int")
    run = lambda i: F.slice(tokens, at(i) + DEPTH + 1, at(i + 1) - at(i))
    hashed = lambda i: F.when(~F.exists(run(i), F.isnull), F.xxhash64(leaf, i, run(i)))
    return F.array_compact(F.transform(F.sequence(F.lit(0).cast("long"), n_runs - 1), hashed))


def folded(others: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """set, template: the sets of each leaf in the order of their rank; one that agrees with no template so far is one, any other belongs to the first that it agrees with."""
    in_order = F.sort_array(F.collect_list(F.struct("rank", "marks")), asc=False).alias("sets")
    leaves = others.groupBy("leaf", "n_tokens").agg(in_order)
    agree = lambda one, other: F.size(F.array_intersect(one["marks"], other["marks"])) >= similar * F.col("n_tokens")
    none = F.slice("sets", 1, 0)
    more = lambda so_far, one: F.when(F.exists(so_far, lambda t: agree(one, t)), so_far).otherwise(F.concat(so_far, F.array(one)))
    leaves = leaves.withColumn("templates", F.aggregate("sets", none, more))
    one = leaves.select("n_tokens", "templates", F.explode("sets").alias("one"))
    first = F.get(F.filter("templates", lambda t: agree(F.col("one"), t)), F.lit(0))
    return one.select(F.col("one.rank.set").alias("set"), first["rank"]["set"].alias("template"))


def templates_of_sets(sets: DataFrame, least_documents: int = LEAST_DOCUMENTS, similar: float = SIMILAR) -> DataFrame:
    """set, template: in each leaf the best supported set is a template, then the best of those that agree with no template so far, and so on; a set belongs to the best supported template that it agrees with.

    The best set of each leaf comes first and takes most of the others.  Leaves
    with few sets left go through them in order (``folded``).  Elsewhere a round
    finds at once every set that no better supported one shares a run with, and
    takes away the sets that agree with these: the same templates as one after
    another, but as many rounds as the longest chain of sets that each share a
    run with a better one, whatever the number of templates.  A leaf with too
    few texts to recur has none.
    """
    rank = F.struct("texts", F.size("marks").alias("n_fixed"), "set").alias("rank")
    # marks and tokens go with the set; as keys they are hashed, as values they would be sorted
    once = sets.groupBy("leaf", "set", "n_tokens", "marks", "tokens").agg(F.sum("texts").alias("texts"))
    every = settled(once.select("leaf", "set", "n_tokens", "marks", "tokens", rank), "sets")
    agrees = F.size(F.array_intersect("marks", "its")) >= similar * F.col("n_tokens")

    best = every.groupBy("leaf", "n_tokens").agg(F.max(F.struct("rank", "marks")).alias("best"), F.sum("rank.texts").alias("all"))
    best = best.where(F.col("all") >= enough_texts(F.col("n_tokens"), least_documents))
    best = settled(best.select("leaf", F.col("best.rank.set").alias("template"), F.col("best.marks").alias("its")), "leaders")
    met = settled(every.join(small(best, BROADCAST_TEMPLATES), "leaf").withColumn("agrees", agrees), "round")
    keys = keys_of_sets(F.col("n_tokens"), F.col("tokens"), F.col("leaf"), similar).alias("keys")
    others = settled(met.where("NOT agrees").select("leaf", "set", "n_tokens", "tokens", "marks", "rank"), "others")
    found = met.where("agrees").select("set", "template")
    crowded = others.groupBy("leaf").count().where(F.col("count") > FOLDED_SETS).select("leaf")
    crowded = small(settled(crowded, "crowded"), BROADCAST_LEAVES)
    found = found.unionByName(folded(others.join(crowded, "leaf", "left_anti"), similar))
    if crowded.isEmpty():
        return found
    others = others.join(crowded, "leaf", "left_semi").select("set", "n_tokens", "marks", "rank", keys, F.lit(False).alias("leads"))
    keyed = lambda df, *columns: df.select(F.explode("keys").alias("key"), *columns)

    def agreeing(some: DataFrame, leaders: DataFrame) -> DataFrame:
        # pairs travel as two names; the marks of both meet once for each pair
        pairs = keyed(some, "set").join(keyed(leaders, F.col("set").alias("template")), "key").select("set", "template").distinct()
        its = leaders.select(F.col("set").alias("template"), F.col("rank").alias("its_rank"), F.col("marks").alias("its"))
        return some.select("set", "n_tokens", "marks").join(pairs, "set").join(its, "template").where(agrees)

    state = others = settled(others, "others")
    while not (left := state.where("NOT leads")).isEmpty():
        top = keyed(left, "rank").groupBy("key").agg(F.max("rank").alias("top"))
        beaten = keyed(left, "set", "rank").join(top, "key").where("rank <> top").select("set").distinct()
        fresh = settled(left.join(beaten, "set", "left_anti"), "leaders").withColumn("leads", F.lit(True))
        rest = left.join(fresh.select("set"), "set", "left_anti")
        rest = rest.join(agreeing(rest, fresh).select("set").distinct(), "set", "left_anti")
        state = settled(state.where("leads").unionByName(fresh).unionByName(rest), "round")
    # a leader agrees with no better one, so it is its own template
    later = agreeing(others, state).groupBy("set").agg(F.max("its_rank").alias("best"))
    return found.unionByName(later.select("set", F.col("best.set").alias("template")))


def bounds_of(n_tokens: Column, similar: float = SIMILAR) -> Column:
    """no, start and size of the runs of a line with so many tokens: one more run than tokens may differ, so lines that agree share a run."""
    n_runs = n_tokens - F.ceil(similar * n_tokens) + 1
    at = lambda i: F.floor(i * n_tokens / n_runs).cast("int")
    bounds = lambda i: F.struct(i.alias("no"), (at(i) + 1).alias("start"), (at(i + 1) - at(i)).alias("size"))
    return F.transform(F.sequence(F.lit(0).cast("long"), n_runs - 1), bounds)


def run_of(tokens: Column, at: Column) -> Column:
    """Hash of the run of tokens with those bounds."""
    return F.xxhash64(F.size(tokens), at["no"], F.slice(tokens, at["start"], at["size"]))


def runs_of(tokens: Column, bounds: Column, variable: bool = False) -> Column:
    """Hashes of the runs of tokens.  With ``variable`` tokens, null for runs with a null."""
    whole = lambda at: ~F.exists(F.slice(tokens, at["start"], at["size"]), F.isnull)
    return F.transform(bounds, (lambda at: F.when(whole(at), run_of(tokens, at))) if variable else (lambda at: run_of(tokens, at)))


def runs_of_templates(templates: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """run, template, texts, top, before: the runs of templates; in each run the best supported template is its top; before is the run before it of that template that is top, or not, as well."""
    runs = F.posexplode(runs_of(F.col("tokens"), bounds_of(F.size("tokens"), similar), variable=True)).alias("no", "run")
    runs = settled(templates.select("template", "texts", runs).where("run IS NOT NULL"), "runs")
    best = runs.groupBy("run").agg(F.max(F.struct("texts", "template")).alias("best"))
    runs = runs.join(best, "run").withColumn("top", F.col("best.template") == F.col("template"))
    before = F.lag("run").over(Window.partitionBy("template", "top").orderBy("no"))
    return settled(runs.select("run", "template", "texts", "top", before.alias("before")), "before")


def lines_that_agree(lines: DataFrame, templates: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, digest, line_no, template, texts: lines of any leaf that agree with a template (template, texts, tokens, marks); fields may lead a line.  The best supported one of a line is among its rows.

    Which runs of lines are runs of templates at all is told by a broadcast of
    nothing but their hashes; the few lines that have any then meet the templates.

    A line meets the top template of each of its runs first, and the others of
    those runs only if they are better supported than one that it agrees with,
    so a passage with a thousand edits and dozens of templates makes no row for
    each two of them.  A line and a template meet only where the runs that they
    share begin, not in each of a row of shared runs.
    """
    runs = runs_of_templates(templates, similar)
    # only lines with as many tokens as some template; numbers of tokens are few, and each has its bounds once
    sizes = templates.select(F.size("tokens").alias("n_tokens")).distinct()
    sizes = small(settled(sizes.withColumn("bounds", bounds_of(F.col("n_tokens"), similar)), "sizes"), BROADCAST_LEAVES)
    its = templates.select("template", F.col("marks").alias("its"))
    agrees = (F.size(F.array_intersect(marks_of(F.col("tokens")), F.col("its"))) >= similar * F.size("tokens")).alias("agrees")
    line = ("doc_id", "digest", "line_no", "tokens", "bounds")

    def met(lines: DataFrame, runs: DataFrame, label: str) -> DataFrame:
        # a run is hashed after its bounds are exploded: in a transform of the bounds it would be interpreted
        at = lines.withColumn("at", F.explode("bounds")).withColumn("key", run_of(F.col("tokens"), F.col("at"))).drop("at")
        n_runs = runs.limit(BROADCAST_RUNS + 1).count()
        if n_runs <= BROADCAST_RUNS:
            # a bucket has its runs, and a bit for each by which most others are told at once
            bucket = lambda run: F.pmod(run, F.lit(n_runs // RUNS_OF_BUCKET + 1).cast("long"))
            bit = lambda run: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(run, 58).cast("int"))
            buckets = runs.groupBy(bucket(F.col("run")).alias("bucket")).agg(F.bit_or(bit(F.col("run"))).alias("bits"), F.collect_set("run").alias("its_runs"))
            known = (F.col("bits").bitwiseAND(bit(F.col("key"))) != 0) & F.array_contains("its_runs", F.col("key"))
            at = at.join(F.broadcast(buckets), (bucket(F.col("key")) == F.col("bucket")) & known).drop("bucket", "bits", "its_runs")
        else:  # too many to broadcast: only short rows are shuffled by run, and then the lines that meet any
            hit = at.select("doc_id", "digest", "line_no", "key").join(runs, F.col("key") == F.col("run"), "left_semi")
            hit = hit.select(*(F.col(c).alias(f"hit_{c}") for c in ("doc_id", "digest", "line_no")), F.col("key")).distinct()
            same = [F.col(c).eqNullSafe(F.col(f"hit_{c}")) for c in ("doc_id", "digest", "line_no")]
            at = lines.join(settled(hit, "hit"), same)
        at = settled(at.select(*lines.columns, "key"), "hit").withColumn("runs", runs_of(F.col("tokens"), F.col("bounds")))
        begins = (F.col("key") == F.col("run")) & (F.col("before").isNull() | ~F.array_contains("runs", F.col("before")))
        if "least" in lines.columns:
            begins &= F.col("least").isNull() | (F.struct("texts", "template") > F.col("least"))
        return settled(at.join(runs, begins).join(its, "template").select(*line, "template", "texts", agrees), label)

    # never null, so that no filter on nulls splits a line a second time
    sized = lines.withColumn("n_tokens", F.coalesce(F.size("tokens"), F.lit(0))).join(sizes, "n_tokens")
    tops = met(sized.select(*line), runs.where("top").drop("top"), "tops")
    least = F.max(F.when(F.col("agrees"), F.struct("texts", "template"))).alias("least")
    others = met(tops.groupBy(*line).agg(least), runs.where("NOT top").drop("top"), "others")
    return tops.unionByName(others).where("agrees").select("doc_id", "digest", "line_no", "template", "texts")


def recurring_lines(
    lines: DataFrame, leaves: DataFrame, known: DataFrame, least_documents: int = LEAST_DOCUMENTS, similar: float = SIMILAR
) -> DataFrame:
    """doc_id, digest, line_no, first_doc: the lines of templates that recur in at least ``least_documents`` texts, long ones in LEAST_LONG."""
    sets = settled(constant_sets(known, least_documents, similar), "constants")
    templates = templates_of_sets(sets, least_documents, similar)
    shapes = settled(sets.select("leaf", "shape", "set").join(templates, "set").select("shape", "template"), "templates")
    own = known.select("doc_id", "digest", "line_no", "shape").join(shapes, "shape").drop("shape")
    texts = own.groupBy("template").agg(F.countDistinct("digest").alias("texts"))
    heads = sets.select(F.col("set").alias("template"), "tokens", "marks").distinct()
    recurs = F.col("texts") >= enough_texts(F.size("tokens"), least_documents)
    recurring = settled(texts.join(heads, "template").where(recurs), "recurring")
    own = own.join(small(recurring.select("template", "texts"), BROADCAST_LEAVES), "template").withColumn("own", F.lit(True))
    own_shapes = small(settled(shapes.join(recurring, "template").select("shape"), "own"), BROADCAST_LEAVES)
    columns = ("doc_id", "digest", "line_no", "tokens")
    rare = lines.join(small(leaves, BROADCAST_LEAVES), "leaf", "left_anti").select(*columns)
    unplaced = rare.unionByName(known.join(own_shapes, "shape", "left_anti").select(*columns))
    other = lines_that_agree(unplaced, recurring, similar).withColumn("own", F.lit(False))
    # a line's template of its own leaf comes first, then the best supported one
    line = own.unionByName(other).groupBy("doc_id", "digest", "line_no").agg(F.max(F.struct("own", "texts", "template")).alias("best"))
    line = settled(line.select("doc_id", "digest", "line_no", F.col("best.template").alias("template")), "placed")
    first = line.groupBy("template").agg(F.min("doc_id").alias("first_doc"))
    return line.join(small(settled(first, "first"), BROADCAST_LEAVES), "template").drop("template")


def drop_recurring_lines(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, similar: float = SIMILAR, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """The documents with their own columns, the text without its recurring lines, and n_lines and n_dropped."""
    lines = document_lines(docs, text, key)
    leaves = lines.groupBy("leaf", F.size("tokens").alias("n_tokens"), lead_of_tokens(F.col("tokens")).alias("lead")).agg(F.countDistinct("digest").alias("n"))
    leaves = leaves.where(F.col("n") >= enough_texts(F.col("n_tokens"), least_documents)).select("leaf", "lead")
    leaves = settled(leaves, "leaves")
    leads, leaves = leaves.select("lead").distinct(), leaves.select("leaf")
    few = leads.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    known = settled(lines_of_leaves(document_lines(docs, text, key, mask=True, leads=leads if few else None), leaves), "known")
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    doc, digest, gone = (free_name(c, docs.columns) for c in ("doc", "digest", "gone"))
    lost = (
        recurring_lines(lines, leaves, known, least_documents, similar)
        .where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy(F.col("doc_id").alias(doc), F.col("digest").alias(digest))
        .agg(F.collect_set("line_no").alias(gone))
    )
    whole = F.col(f"`{text}`")
    all_lines = F.split(whole, "\n", -1)
    kept = F.filter(all_lines, lambda _, i: ~F.array_contains(F.col(gone), i))
    same = F.col(f"`{key}`").eqNullSafe(F.col(doc)) & (F.xxhash64(whole) == F.col(digest))
    joined = docs.select(*(f"`{c}`" for c in own)).join(lost.hint("shuffle_hash"), same, "left")
    cleaned = F.when(F.col(gone).isNull(), whole).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *(cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in own),
        F.when(whole.isNull(), 0).otherwise(F.size(all_lines)).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )


def without_recurring_lines(docs: DataFrame) -> DataFrame:
    """For a pipeline: the documents' own columns; a document whose every line with a word was dropped is gone."""
    found = drop_recurring_lines(docs)
    emptied = (F.col("n_dropped") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return found.where(~F.coalesce(emptied, F.lit(False))).select(*(f"`{c}`" for c in docs.columns))

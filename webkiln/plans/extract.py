"""Extraction end to end: pages to one record each."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webkiln.functions.text import count_words
from webkiln.html.shred import shred
from webkiln.operators import content, dispatch, metadata, patterns, removals, render, selectors, standardise
from webkiln.sources.shared import materialise


@dataclass(frozen=True)
class Options:
    """What a plan does; a step that is None stays at its default, which is on.  ``debug`` keeps structure and debugging attributes.

    ``content_selector`` names the main content: the first element that it finds on a page; pages where it finds none are
    treated as without it.  ``remove_images`` removes every image, whatever its size.
    """

    markdown: bool = False
    remove_small_images: bool | None = None
    remove_hidden: bool | None = None
    remove_exact: bool | None = None
    remove_partial: bool | None = None
    remove_low_scoring: bool | None = None
    remove_content_patterns: bool | None = None
    remove_images: bool = False
    content_selector: str | None = None
    debug: bool = False

    def steps(self) -> tuple[str, ...]:
        flags = {"small": self.remove_small_images, "hidden": self.remove_hidden, "low": self.remove_low_scoring, "exact": self.remove_exact, "partial": self.remove_partial, "patterns": self.remove_content_patterns, "images": self.remove_images}
        return tuple(step for step, on in flags.items() if on is not False)


def chosen_content(nodes: DataFrame, selector: str | None = None) -> DataFrame:
    """The main content of every page: what ``selector`` finds first, else the best candidate."""
    best = content.main_content(nodes)
    if selector is None:
        return best
    first = selectors.first_match(nodes, selector).select("page_id", "pre")
    measured = content.measured(nodes)
    named = content.subtree_totals(measured, measured.join(first, ["page_id", "pre"]))
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in best.schema if f.name not in named.columns}
    named = named.select(*[none.get(c, F.col(c)) for c in best.columns])
    return named.unionByName(best.join(named.select("page_id"), "page_id", "left_anti"))


def parsed(pages: DataFrame, selector: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The node table, the main content and the metadata of all pages, each computed once."""
    nodes = materialise(content.measured(shred(pages)), "nodes")  # four later steps read the running totals
    return nodes, materialise(chosen_content(nodes, selector), "main"), materialise(metadata.page_metadata(pages, nodes), "metadata")


def cleaned(marked: DataFrame, main: DataFrame, titles: DataFrame, steps: tuple[str, ...], debug: bool = False, tries: DataFrame | None = None) -> DataFrame:
    """The main content's nodes after removal and standardisation.

    ``marked`` are the nodes with their marks per step.  With ``tries`` (page_id, rung, try_id) every page is cleaned
    once for each of its rungs, which leave steps out; ``try_id`` is then the id of the page.
    """
    unless = None
    if tries is not None:
        unless = {s: F.col("rung").isin(*[r for r, (without, _, _) in enumerate(LADDER, 1) if s in without]) for s in steps}
        marked, main, titles = (x.join(tries, "page_id").withColumn("page_id", F.col("try_id")).drop("try_id") for x in (marked, main, titles))
    kept = [c for c in marked.columns if not c.startswith("is_")]
    left = removals.remove(marked.select(*kept, removals.reason(steps, unless).alias("reason")))
    left = removals.subtree(left, main)
    if "patterns" in steps:
        left = materialise(left, "inside")
        looked = None if tries is None else left.filter(~unless["patterns"])
        left = removals.remove(patterns.mark_patterns(left, main, looked))
    return standardise.standardise(left, titles, debug)


#: Fixed values: (steps to leave out, tried below so many words, must grow by this factor).
LADDER = ((("partial",), 200, 1), (("hidden",), 50, 2), (("low", "partial", "patterns"), 50, 1))


#: The first plan tries the rungs of pages that have up to so many times a rung's words before any removal.
LIKELY = 2


def _can_differ(marked: DataFrame, main: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """(page_id, words, can): the rungs of each page that leave out a step which found something in or around the main content.

    Any other rung gives what rung 0 gives, so it never wins.  What content patterns find is not known yet.
    """
    out = [[s for s in without if s in steps] for without, _, _ in LADDER]
    asked = sorted({s for dropped in out for s in dropped if s != "patterns"})
    main = main.select("page_id", "words", F.col("pre").alias("main_pre"), F.col("last").alias("main_last"))
    found = marked.select("page_id", "pre", "last", *[f"is_{s}" for s in asked])
    found = found.filter(reduce(lambda a, b: a | b, [F.col(f"is_{s}") for s in asked], F.lit(False)))
    found = found.join(main, "page_id").filter("pre <= main_last AND last >= main_pre")
    found = found.groupBy("page_id").agg(F.count("*").alias("n"), *[F.bool_or(f"is_{s}").alias(s) for s in asked])
    does = lambda s: F.lit(True) if s == "patterns" else F.coalesce(s, F.lit(False))
    can = [F.when(reduce(lambda a, b: a | b, map(does, dropped), F.lit(False)), F.lit(rung)) for rung, dropped in enumerate(out, 1)]
    return main.join(found, "page_id", "left").select("page_id", "words", F.array_compact(F.array(*can)).alias("can"))


def _needed(first: bool) -> Column:
    """The rungs that a page with ``words`` comes to and that ``can`` differ; the first plan has rung 0 of all."""
    rungs = [F.when((F.col("words") < below) & F.array_contains("can", rung), F.lit(rung)) for rung, (_, below, _) in enumerate(LADDER, 1)]
    return F.array_compact(F.array(*[F.lit(0)] * first, *rungs))


def _tries(words: DataFrame, first: bool) -> DataFrame:
    """(page_id, rung, try_id): the rungs that pages (page_id, words, can) come to."""
    tries = words.select("page_id", F.explode(_needed(first)).alias("rung"))
    at = F.monotonically_increasing_id() * 2 + (0 if first else 1)
    return materialise(tries.withColumn("try_id", at), "tries")


def with_ladder(nodes: DataFrame, main: DataFrame, titles: DataFrame, options: Options) -> DataFrame:
    """Cleaned nodes and the ladder step that gave them, pages with few words retried with fewer steps.

    What a step finds does not depend on the others, so elements are marked once.  One plan cleans all pages, and those
    with few words before any removal for each rung that they may come to and that can differ as well; a second one does
    the rungs of pages that only removal made short, if there are any.  A page then climbs the rungs by its
    counts of words, each of which has to be enough more than the one before.
    """
    steps = options.steps()
    marked = materialise(removals.mark_steps(nodes, main, steps), "marked")
    can = materialise(_can_differ(marked, main, steps), "can")
    tries = _tries(can.withColumn("words", F.col("words") / LIKELY), True)
    done = materialise(cleaned(marked, main, titles, steps, options.debug, tries), "rungs")

    def counted(done: DataFrame, tries: DataFrame) -> DataFrame:
        words = render.to_text(done).select(F.col("page_id").alias("try_id"), count_words(F.trim("content_text")).alias("words"))
        return materialise(tries.join(words, "try_id", "left").withColumn("words", F.coalesce("words", F.lit(0))), "words")

    words = counted(done, tries)
    rungs = words.groupBy("page_id").agg(F.max(F.when(F.col("rung") == 0, F.col("words"))).alias("words"), F.collect_set("rung").alias("tried"))
    rungs = rungs.join(can.select("page_id", "can"), "page_id")
    late = materialise(rungs.filter(F.size(F.array_except(_needed(False), "tried")) > 0).select("page_id", "words", "can"), "late")
    if not late.isEmpty():
        missing = _tries(late, False).join(tries.select("page_id", "rung"), ["page_id", "rung"], "left_anti")
        missing = materialise(missing, "tries")
        again = materialise(cleaned(marked, main, titles, steps, options.debug, missing), "rungs")
        done, words = done.unionByName(again), words.unionByName(counted(again, missing))
    pivot = words.groupBy("page_id").agg(*[F.max(F.when(F.col("rung") == r, F.col("words"))).alias(f"w{r}") for r in range(len(LADDER) + 1)])
    at = F.struct(F.col("w0").alias("words"), F.lit(0).alias("rung"))
    for rung, (_, below, factor) in enumerate(LADDER, 1):
        better = F.coalesce((at["words"] < below) & (F.col(f"w{rung}") > at["words"] * factor), F.lit(False))
        at = F.when(better, F.struct(F.col(f"w{rung}").alias("words"), F.lit(rung).alias("rung"))).otherwise(at)
    won = words.select("page_id", "rung", "try_id").join(pivot.select("page_id", at["rung"].alias("rung")), ["page_id", "rung"])
    columns = [c for c in done.columns if c != "page_id"]
    return done.withColumnRenamed("page_id", "try_id").join(won, "try_id").select("page_id", *columns, F.col("rung").alias("retry_step"))


def extract(
    pages: DataFrame, options: Options | None = None, nodes: DataFrame | None = None, ladder: bool = True, retry_step: bool = False
) -> DataFrame:
    """One record per page: metadata, extractor, content, word_count and Markdown if asked for.

    ``retry_step`` adds the ladder's step that gave the record, 0 for the first pass.
    """
    options = options or Options()
    nodes, main, about = parsed(pages, options.content_selector) if nodes is None else (nodes, chosen_content(nodes, options.content_selector), metadata.page_metadata(pages, nodes))
    if ladder:
        left = with_ladder(nodes, main, about, options)
    else:
        marked = removals.mark_steps(nodes, main, options.steps())
        left = cleaned(marked, main, about, options.steps(), options.debug).withColumn("retry_step", F.lit(0))
    left = materialise(left, "cleaned")
    written = render.to_all(left, pages, options.markdown)
    written = written.withColumn("word_count", count_words(F.trim("content_text"))).drop("content_text")
    out = (
        about.join(dispatch.dispatch(pages).select("page_id", "extractor"), "page_id")
        .join(written, "page_id", "left")
        .withColumn("word_count", F.coalesce("word_count", F.lit(0)))
    )
    if retry_step:
        steps = left.groupBy("page_id").agg(F.max("retry_step").alias("retry_step"))
        out = out.join(steps, "page_id", "left").withColumn("retry_step", F.coalesce("retry_step", F.lit(0)))
    return out

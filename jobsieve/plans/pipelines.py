"""The four end-to-end chains: structured collect, page collect, export, verdict memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsieve.operators import blocks as B
from jobsieve.operators import dedupe as D
from jobsieve.operators import exporting as E
from jobsieve.operators import filters as FL
from jobsieve.operators import hits as N
from jobsieve.operators import ordering as O
from jobsieve.operators import pagefacts as P
from jobsieve.operators import verdicts as V
from jobsieve.sources import memory as M

HITS_PER_PAGE = 1_000_000  # only spaces page numbers apart so that page and hit number give one order


def collect_structured(
    pages: DataFrame, details: DataFrame, now_ms: int | None = None, max_jobs: int = 0, max_pages: int = 0,
    known: DataFrame | None = None, fill_from_prose: bool = False,
) -> DataFrame:
    """Search pages (``page_no, html``) and detail bodies (``job_id, body``) to new postings.

    Expired and repeated hits go, and the caps apply, before the description join, so the join sees each
    id once and no text is looked up for a row that is about to be dropped.
    """
    hits = N.drop_expired(N.explode_hits(N.read_search_pages(O.cap_pages(pages, max_pages))))
    hits = hits.withColumn("seq", F.col("page_no") * HITS_PER_PAGE + F.col("hit_no")).withColumn(
        "job_id", N.hit_id(F.col("hit"))).where("job_id is not null")
    live = O.cap_jobs(D.dedupe_first(hits.select("job_id", "seq", "hit")), max_jobs)
    if known is not None:
        live = D.skip_known(live, known)
    # Bodies are turned into text only for ids that are left.
    wanted = details.join(live.select("job_id"), "job_id", "left_semi")
    with_text = N.join_descriptions(live, N.read_detail_json(wanted))
    return N.normalise_hit(with_text, now_ms=now_ms, fill_from_prose=fill_from_prose)


def collect_pages(
    pages: DataFrame, key: str = "page_id", history: DataFrame | None = None, verdicts: DataFrame | None = None,
) -> DataFrame:
    """Posting pages (with the ``job_id`` each shows) to postings; known ids are skipped before parsing."""
    todo = pages
    if history is not None:
        todo = D.skip_known(todo, history)
    if verdicts is not None:
        todo = D.skip_known(todo, verdicts.where("verdict = 'reject'"))
    return P.build_postings(B.page_parts(B.html_blocks(todo), key))


def export_rows(
    postings: DataFrame, spec: FL.FilterSpec, history: DataFrame | None = None, verdicts: DataFrame | None = None,
    deselected: DataFrame | None = None,
) -> DataFrame:
    """Filtered, selected and numbered rows with their blocks, in display order."""
    kept = FL.apply_filters(postings, spec, history, verdicts)
    if deselected is not None:
        kept = FL.select_rows(kept, deselected)
    return E.with_blocks(kept, O.sort_values(spec.sort, spec.q, postings.columns))


def export_batches(
    postings: DataFrame, spec: FL.FilterSpec, history: DataFrame | None = None, verdicts: DataFrame | None = None,
    budget: int = E.DEFAULT_BUDGET, prompt: str = E.DEFAULT_PROMPT, reply_format: str = E.DEFAULT_REPLY_FORMAT,
) -> DataFrame:
    """Filter, sort, number, pack and render. Text is joined back only after packing."""
    blocks = export_rows(postings, spec, history, verdicts)
    return E.render_batches(blocks, E.pack_batches(blocks, ["job_no"], budget), prompt, reply_format)


def scan_verdicts(chats: DataFrame, store: DataFrame, source: str = "chat") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chat text into verdict memory: ``(merged store, counts, ambiguous lines)``."""
    lines = V.read_chat_lines(chats)
    found = V.latest_verdict(V.parse_verdicts(lines)).select(
        "job_id", "verdict", "reason", F.current_timestamp().alias("at"), F.lit(source).alias("source"))
    merged, counts = V.merge_verdicts(store, found)
    return merged, counts, V.ambiguous_lines(lines)


def tag_rows(postings: DataFrame, history: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Show, without removing, what was exported before and how it was judged: the newest verdict of an id, one row each."""
    seen = history.select("job_id", F.lit(True).alias("_seen")).distinct()
    said = M.newest(verdicts, "job_id", "at") if "at" in verdicts.columns else verdicts.dropDuplicates(["job_id"])
    said = said.select("job_id", "verdict", "reason")
    both = postings.join(seen, "job_id", "left").join(said, "job_id", "left")
    return both.withColumn("seen", F.coalesce("_seen", F.lit(False))).drop("_seen")

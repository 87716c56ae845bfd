"""Queries of the problems on free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from ..session import through_table
from .abuse import background_texts, fit_from_table, score_texts
from .contamination import leaked_items
from .lookalikes import confused_tokens, lookalike_classes, lookalike_pairs, with_form
from .mixing import mix_sources, token_counts
from .personal import find_personal
from .shared_spans import representative_spans, shared_parts, shared_spans, text_classes, without_shared

#: A comment counts as abusive from this score on: set on out-of-fold scores of the labelled rows.
ABUSE_THRESHOLD = 0.8
#: A document is listed for an item from this alignment score on, or with a run of 60 letters and digits.
LEAK_SCORE = 0.6
SPAN = 300
RUN = 60


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = find_personal(table(spark, d, "chat_comments"), "delivery_id", ["content", "name"])
    return found.select("delivery_id", "field", F.explode(F.array_distinct("kinds")).alias("kind"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Each text with placeholders, and what was found where."""
    return find_personal(table(spark, d, "chat_comments"), "delivery_id", ["content", "name"], redacted=True)


def comments(spark: SparkSession, d: str) -> DataFrame:
    chat = table(spark, d, "chat_comments").select(F.lit("chat_comments").alias("table_name"), F.col("delivery_id").alias("row_id"), "live_id", "content")
    op = table(spark, d, "operator_comments").select(F.lit("operator_comments").alias("table_name"), F.col("op_delivery_id").alias("row_id"), "live_id", "content")
    return chat.unionByName(op)


def p4_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = comments(spark, d)
    scorer = fit_from_table(table(spark, d, "abuse_labels"), "text", "label", "label_id", background_texts(rows, "content"))
    return score_texts(rows, "content", ["table_name", "row_id", "live_id"], scorer)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_scores(spark, d).where(F.col("score") >= ABUSE_THRESHOLD).select("table_name", "row_id")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rows and share of abuse per table (level `table`) and per programme of it (level `programme`; its live_id may be null)."""
    bad = F.col("score") >= ABUSE_THRESHOLD
    return (
        p4_scores(spark, d)
        .rollup("table_name", "live_id")
        .agg(F.when(F.grouping("live_id") == 1, "table").otherwise("programme").alias("level"), F.grouping("table_name").alias("_all"), F.count("*").alias("texts"), F.count_if(bad).alias("flagged"), *[F.count_if(bad & (F.col("label") == x)).alias(x) for x in ("abusive", "hateful", "sexual")])
        .where("_all = 0")
        .drop("_all")
        .withColumn("rate", F.col("flagged") / F.col("texts"))
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    chat = lookalike_pairs(table(spark, d, "chat_comments"), ["live_id", "user_id"], "delivery_id", "content").select(F.lit("chat_comments").alias("table_name"), "row_id_a", "row_id_b")
    mods = lookalike_pairs(table(spark, d, "moderator_updates"), ["live_id"], "update_id", "nickname").select(F.lit("moderator_updates").alias("table_name"), "row_id_a", "row_id_b")
    return chat.unionByName(mods)


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per row with a look-alike: its class and how many spellings that has. The same links as p6_found, without pairs."""
    chat = lookalike_classes(table(spark, d, "chat_comments"), ["live_id", "user_id"], "delivery_id", "content").select(F.lit("chat_comments").alias("table_name"), "row_id", "class_id", "spellings", "form")
    mods = lookalike_classes(table(spark, d, "moderator_updates"), ["live_id"], "update_id", "nickname").select(F.lit("moderator_updates").alias("table_name"), "row_id", "class_id", "spellings", "form")
    return chat.unionByName(mods)


def p6_confusables(spark: SparkSession, d: str) -> DataFrame:
    """Rows with words that mix scripts, or that are of another script throughout and read as Latin."""
    chat = table(spark, d, "chat_comments").select(F.lit("chat_comments").alias("table_name"), F.col("delivery_id").alias("row_id"), F.col("content").alias("text"))
    mods = table(spark, d, "moderator_updates").select(F.lit("moderator_updates").alias("table_name"), F.col("update_id").alias("row_id"), F.col("nickname").alias("text"))
    return confused_tokens(chat.unionByName(mods), "text").where("mixed > 0 or whole > 0").drop("text")


def p6_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text that has another one."""
    chat = table(spark, d, "chat_comments").select(F.lit("chat_comments").alias("table_name"), F.col("delivery_id").alias("row_id"), F.col("content").alias("text"))
    mods = table(spark, d, "moderator_updates").select(F.lit("moderator_updates").alias("table_name"), F.col("update_id").alias("row_id"), F.col("nickname").alias("text"))
    return with_form(chat.unionByName(mods), "text").where("form is not null and form <> text")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", run=RUN)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The alignment decides first: a common run of RUN scores at least its matches, 2 each. The exact check of the run follows."""
    return _leaks(spark, d).where((F.col("alignment") >= 2 * RUN) & (F.col("run") >= RUN)).select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per affected document and item: alignment, its share of the item's best, longest exact run and where. The alignment decides: as much as a
    run of RUN is worth, or LEAK_SCORE of the item; paraphrases and edited copies are in by it."""
    return _leaks(spark, d).where((F.col("alignment") >= 2 * RUN) & (F.col("run") >= RUN) | (F.col("score") >= LEAK_SCORE))


def _mix(spark: SparkSession, d: str, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """A mixture as large as the listed sources with a share are together, or the largest one in which every share is met."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    counts = through_table(token_counts(docs, "text", ["doc_id", "source"]), "tokens")
    total = counts.join(targets.where("target_share > 0").select("source"), "source", "left_semi").agg(F.sum("n_tokens")).first()[0] if whole else None
    return mix_sources(docs, "doc_id", "source", targets, total=total, counts=counts)


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per listed source what it was to supply, what it supplied and how far that is from its target."""
    return _mix(spark, d)[1]


def p8_exact_selection(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixture in which every share is met: the smallest capped source fixes its size."""
    return _mix(spark, d, whole=False)[0]


def p8_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, whole=False)[1]


def p8_rates_by_chars(spark: SparkSession, d: str) -> DataFrame:
    """The arithmetic of the exact mixture, sizes in code points instead of tokens, so that SQL can follow."""
    docs = table(spark, d, "documents")
    counts = docs.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_tokens"))
    shares = mix_sources(docs, "doc_id", "source", table(spark, d, "mix_targets"), counts=counts)[1]
    return shares.select("source", "documents", F.col("tokens").alias("chars"), F.round("rate", 9).alias("rate"), F.round("scaled_share", 9).alias("scaled_share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents"), "doc_id", "text", SPAN).select("doc_id_a", "doc_id_b").distinct()


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per document: how many of its code points lie in spans that occur in another document too; 0 for those that share nothing."""
    parts = shared_parts(table(spark, d, "documents"), "doc_id", "text", SPAN)
    shared = parts.groupBy(F.col("d").alias("doc_id")).agg(F.count("*").alias("spans"), F.sum(F.col("b") - F.col("a")).alias("shared_chars"))
    every = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars")).distinct()
    zero = F.lit(0).cast("bigint")
    return every.join(shared, "doc_id", "left").select(
        "doc_id", F.coalesce("spans", zero).alias("spans"), F.coalesce("shared_chars", zero).alias("shared_chars"), "chars",
        F.when(F.col("shared_chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(0.0).alias("shared_share"),
    )


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Per document: the first document with the same whole text, how many have it, and with how many other texts it shares spans. No pairs of copies."""
    docs = table(spark, d, "documents")
    classes = text_classes(docs, "doc_id", "text", SPAN)
    spans = through_table(representative_spans(docs, "doc_id", "text", classes, SPAN).select("doc_id_a", "doc_id_b").distinct(), "links")
    links = spans.select(F.col("doc_id_a").alias("r")).unionByName(spans.select(F.col("doc_id_b").alias("r"))).groupBy("r").agg(F.count("*").alias("links"))
    size = classes.groupBy(F.col("r").alias("class_id")).agg(F.count("*").alias("copies"))
    rows = docs.select("doc_id").distinct().join(classes.select(F.col("d").alias("doc_id"), F.col("r").alias("class_id")), "doc_id", "left")
    rows = rows.withColumn("class_id", F.coalesce("class_id", "doc_id")).join(size, "class_id", "left").join(links, F.col("class_id") == F.col("r"), "left")
    return rows.select("doc_id", "class_id", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the spans an earlier one has verbatim."""
    return without_shared(table(spark, d, "documents"), "doc_id", "text", SPAN)


QUERIES = {
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p6_found": p6_found,
    "p6_forms": p6_forms,
    "p6_classes": p6_classes,
    "p6_confusables": p6_confusables,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p8_selection": p8_selection,
    "p8_shares": p8_shares,
    "p8_exact_selection": p8_exact_selection,
    "p8_exact_shares": p8_exact_shares,
    "p8_rates_by_chars": p8_rates_by_chars,
    "p9_found": p9_found,
    "p9_coverage": p9_coverage,
    "p9_classes": p9_classes,
    "p9_cleaned": p9_cleaned,
}

# Every window of every text: brute force that SQL can do on small tables only. The others are tested in tests/llm.
ORACLE: dict[str, str] = {
    "p7_found": r"""with n as (select doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') t from documents), m as (select item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') t from eval_items),
      g as (select distinct item_id, substr(t, i::bigint, 60) g from m, lateral (select unnest(range(1, length(t) - 58)) i) where length(t) >= 60),
      d as (select doc_id, substr(t, i::bigint, 60) g from n, lateral (select unnest(range(1, length(t) - 58)) i) where length(t) >= 60)
      select distinct doc_id, item_id from d join g using (g)""",
    "p9_coverage": """with g as (select doc_id, i::bigint i, hash(substr(text, i::bigint, 300)) h from documents, lateral (select unnest(range(1, length(text) - 298)) i) where length(text) >= 300),
      s as (select h from g group by h having count(distinct doc_id) > 1), k as (select distinct doc_id, i from g semi join s using (h)),
      n as (select *, lead(i) over (partition by doc_id order by i) nxt from k),
      c as (select doc_id, count(*) filter (where nxt is null or nxt > i + 300) spans, sum(least(300, coalesce(nxt - i, 300)))::bigint shared_chars from n group by doc_id),
      e as (select distinct doc_id, coalesce(length(text), 0)::bigint chars from documents)
      select doc_id, coalesce(spans, 0)::bigint spans, coalesce(shared_chars, 0)::bigint shared_chars, chars, coalesce(shared_chars / chars, 0)::double as shared_share from e left join c using (doc_id)""",
    "p9_classes": """with t as (select doc_id, text, min(doc_id) over (partition by text) r, count(*) over (partition by text) n from (select distinct doc_id, text from documents)),
      u as (select doc_id, case when length(text) >= 300 then r else doc_id end class_id, case when length(text) >= 300 then n else 1 end::bigint copies, text from t),
      g as (select distinct doc_id, hash(substr(text, i::bigint, 300)) h from u, lateral (select unnest(range(1, length(text) - 298)) i) where length(text) >= 300 and doc_id = class_id),
      s as (select h from g group by h having count(*) > 1), k as (select g.* from g semi join s using (h)),
      l as (select a.doc_id class_id, count(distinct b.doc_id) links from k a join k b on a.h = b.h and a.doc_id <> b.doc_id group by a.doc_id)
      select doc_id, class_id, copies, coalesce(links, 0)::bigint links from u left join l using (class_id)""",
    "p9_cleaned": """with g as (select doc_id, i::bigint i, hash(substr(text, i::bigint, 300)) h from documents, lateral (select unnest(range(1, length(text) - 298)) i) where length(text) >= 300),
      f as (select h, min(doc_id) m from g group by h), k as (select distinct doc_id, i from g join f using (h) where m < doc_id),
      o as (select *, case when i > coalesce(lag(i) over (partition by doc_id order by i), -1000) + 300 then 1 else 0 end new from k),
      p as (select *, sum(new) over (partition by doc_id order by i rows unbounded preceding) part from o),
      r as (select doc_id, part, min(i) a, max(i) + 300 b from p group by doc_id, part),
      q as (select *, coalesce(lag(b) over (partition by doc_id order by a), 1) before, lead(b) over (partition by doc_id order by a) is null as final from r),
      z as (select q.doc_id, string_agg(substr(text, before, a - before) || case when final then substr(text, b) else '' end, '' order by a) kept, sum(b - a)::bigint removed from q join documents using (doc_id) group by q.doc_id)
      select doc_id, case when z.doc_id is null then text else kept end as text, coalesce(removed, 0)::bigint removed from documents left join z using (doc_id)""",
    "p9_found": """with g as (select distinct doc_id, hash(substr(text, i::bigint, 300)) h from documents, lateral (select unnest(range(1, length(text) - 298)) i) where length(text) >= 300),
      s as (select h from g group by h having count(*) > 1), k as (select g.* from g semi join s using (h))
      select distinct a.doc_id doc_id_a, b.doc_id doc_id_b from k a join k b on a.h = b.h and a.doc_id < b.doc_id""",
    "p8_rates_by_chars": """with s as (select source, count(*) documents, sum(coalesce(length(text), 0))::bigint chars from documents group by source),
      t as (select m.source, m.target_share, m.max_repeats, coalesce(s.documents, 0) documents, coalesce(s.chars, 0) chars from mix_targets m left join s using (source)),
      g as (select *, case when target_share > 0 and max_repeats > 0 and chars > 0 then target_share end share from t),
      n as (select *, share / sum(share) over () goal from g), m as (select min(max_repeats * chars / goal) total from n where goal is not null)
      select source, documents, chars, round(case when goal is null then 0 else least(max_repeats::double, goal * total / chars) end, 9) as rate, round(coalesce(goal, 0), 9) scaled_share from n, m""",
}

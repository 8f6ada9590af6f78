"""Sessions, question log, audit, jobs and adoption."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import BLANKS, SPACES_PATTERN, strip, tokenize
from ..session import materialize
from .search import Floor, Weights, blocks_of, containing, keep_best, many_queries, one_line, query_tokens, words_of
from .sequences import first_rows, id_block, running, top_rows

# Words by which a query refers to the owner, and the fixed extra queries.
OWNER_PRONOUNS = ("我", "我的", "本人", "咱们", "我们自己", "我自己", "姓名", "昵称", "叫什么", "是谁", "哪个")
OWNER_FIELDS = ("电话", "手机", "邮箱", "邮件", "微信", "头像", "性别", "单位", "职务", "职位")
OWNER_EXTRAS = ("闪念", "memos", "时间线")
OPENING_ROWS = 64  # rows that a question's rarest words lead to before the floor is taken


def session_table(turns: DataFrame) -> DataFrame:
    """One row per session: turn count, last turn and both previews (first and latest user turn, 80 characters)."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    said = F.substring("content", 1, 80)
    return turns.groupBy("session_id").agg(
        F.count("*").alias("turn_count"), F.max("turn").alias("last_turn"),
        F.coalesce(F.min_by(said, user), F.lit("")).alias("preview"),
        F.coalesce(F.max_by(said, user), F.lit("")).alias("latest_preview"))


def list_sessions(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions with their turn count and a title that falls back to the preview."""
    counts = turns.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("turn_count"))
    return sessions.join(counts, "id", "left").select(
        "id", "updated_at", F.coalesce("turn_count", F.lit(0)).cast("bigint").alias("turn_count"),
        F.coalesce("preview", F.lit("")).alias("preview"),
        F.coalesce(F.nullif(strip(F.coalesce("title", F.lit(""))), F.lit("")), "preview", F.lit("")).alias("title"))


def session_recent(turns: DataFrame, summaries: DataFrame, rounds: int = 6, cut: int = 1200, blanks: str = BLANKS, edges: str = BLANKS) -> DataFrame:
    """The last 2 x rounds turns of each session in order, after its summary if there is one.

    A summary is trimmed of `blanks`, a turn of `edges`; what holds nothing but `blanks` is left out."""
    def trimmed(name: str, of: str) -> Column:
        return F.btrim(F.col(name), F.lit(of))

    last = top_rows(turns, ["session_id"], [F.desc("turn")], 2 * rounds).where(
        F.col("role").isin("user", "assistant") & (trimmed("content", blanks) != ""))
    rows = last.select("session_id", F.col("turn").cast("bigint").alias("position"), "role",
                       F.substring(trimmed("content", edges), 1, cut).alias("content"))
    head = summaries.where(trimmed("summary", blanks) != "").select(
        "session_id", F.lit(-1).cast("bigint").alias("position"), F.lit("user").alias("role"),
        F.substring(trimmed("summary", blanks), 1, 2000).alias("content"))
    return head.unionByName(rows)


def session_digest(turns: DataFrame, rounds: int = 6, keep: int = 24, cut: int = 400, size: int = 1500) -> DataFrame:
    """Digest of the turns older than the recent window, for sessions well past it."""
    recent = 2 * rounds
    counts = turns.groupBy("session_id").agg(F.count("*").alias("turns")).where(F.col("turns") > recent + 2)
    # Only the last recent + keep turns can matter, so the ranking is cut before the shuffle.
    ranked = top_rows(turns, ["session_id"], [F.desc("turn")], recent + keep, "from_end").where(F.col("from_end") > recent)
    line = F.concat(F.when(F.col("role") == "user", "问").otherwise("答"), F.lit("："), F.substring("content", 1, cut))
    joined = (ranked.join(counts, "session_id")
              .groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("ls")))
    return joined.select("session_id", F.substring(F.array_join(F.col("ls.line"), "\n"), 1, size).alias("digest"))


def related_qa(questions: DataFrame, qa: DataFrame, newest: list[Column], limit: int = 3,
               scan: int | None = None) -> DataFrame:
    """Earlier answered questions that share words: overlap with question and answer, half a point more per question word.

    All grounded rows count; `scan` keeps to so many of the `newest`. The words of the questions, the stated query set, are shipped to the
    tasks, and only a task's own best leave it. Questions beyond `QUERY_BYTES` stay a table: words that nearly every row has make no pairs: a question's words are
    taken rarest first. The rows its first words lead to are scored whole and give a floor, the `limit`-th best score; a row that holds none
    of the first p words scores at most 1.5 for each later one, so words are followed only until that is below the floor."""
    recent = qa.where("grounded = 1")
    recent = recent if scan is None else recent.orderBy(*newest).limit(scan)
    if not many_queries(questions):
        return materialize(top_rows(_overlaps(questions, recent, limit), ["query_id"], [F.desc("score"), F.desc("id")], limit), "first")
    rows = recent.select("id", F.array_distinct(tokenize(F.concat_ws(" ", "question", "answer"))).alias("words"),
                         F.array_distinct(tokenize("question")).alias("qw"))
    asked = questions.select("query_id", F.array_distinct(tokenize("text")).alias("tokens"))
    wanted = asked.select("query_id", F.explode("tokens").alias("token"))
    postings = materialize(rows.select("id", F.explode("words").alias("token")).join(wanted.select("token").distinct(), "token"), "postings")
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    rarest = W.partitionBy("query_id").orderBy("df", "token")
    ranked = wanted.join(df, "token").select(
        "query_id", "token", F.row_number().over(rarest).alias("place"), F.count("*").over(W.partitionBy("query_id")).alias("m"),
        (F.sum("df").over(rarest.rowsBetween(W.unboundedPreceding, -1))).alias("before"))
    ranked = materialize(ranked.withColumn("opening", F.coalesce("before", F.lit(0)) < OPENING_ROWS), "ranked")

    def scored(tokens: DataFrame) -> DataFrame:
        """Whole scores of the rows that hold one of the tokens."""
        pairs = postings.join(tokens.select("query_id", "token"), "token").select("query_id", "id").distinct()
        shared = lambda have: F.size(F.array_intersect(have, "tokens"))
        return pairs.join(rows, "id").join(asked, "query_id").select("query_id", "id", (shared("words") + 0.5 * shared("qw")).alias("score"))

    order = [F.desc("score"), F.desc("id")]
    first = materialize(top_rows(scored(ranked.where("opening")), ["query_id"], order, limit), "first")
    floor = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= limit)
    # word number p leads to rows that hold no earlier word: they share it and the m - p later ones at most
    later = ranked.where("not opening").join(floor, "query_id", "left").where(1.5 * (F.col("m") - F.col("place") + 1) >= F.coalesce("floor", F.lit(0.0)))
    found = first.drop("rank").unionByName(scored(later)).distinct()
    return top_rows(found, ["query_id"], order, limit)


def _overlaps(questions: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """`(query_id, id, score)` of the rows that can be among the `k` best of a question, ties included."""
    asked = query_tokens(questions).groupBy("query_id").agg(F.collect_set("token").alias("t"))
    blocks = blocks_of([(r["query_id"], dict.fromkeys(r["t"], 1.0)) for r in asked.toLocalIterator()])
    shared = rows.sparkSession.sparkContext.broadcast(blocks)
    texts = rows.select("id", one_line(tokenize(F.concat_ws(" ", "question", "answer"))).alias("words"), one_line(tokenize("question")).alias("qw"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), texts.schema["id"], T.StructField("score", T.DoubleType())])
    target = to_arrow_schema(schema)

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = [(pa.array([q for q, _ in some], type=pa.int64()), Weights([w for _, w in some]), Floor(len(some), k)) for some in shared.value]
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            for names, weights, floor in held:
                total = np.zeros((len(names), batch.num_rows))
                for at, share in ((1, 1.0), (2, 0.5)):
                    owner, word, _ = words_of(batch.column(at), weights.words)
                    total += weights.product(owner, word, np.full(len(word), share), batch.num_rows)
                qi, ri = keep_best(total, k, True, floor=floor)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(qi)), batch.column(0).take(pa.array(ri)).cast(target.field(1).type), pa.array(total[qi, ri])],
                                                 schema=target)

    return texts.mapInArrow(score, schema)


def query_alias_expand(queries: DataFrame, owner: dict[str, str], limit: int = 8) -> DataFrame:
    """Extra query rows for queries that refer to the owner: names, aliases and fixed words, the first `limit` distinct."""
    import re

    name, nick = owner.get("real_name", "").strip(), owner.get("nickname", "").strip()
    aliases = [a for a in dict.fromkeys(re.split(SPACES_PATTERN, owner.get("aliases", ""))) if a]
    terms = [t for t in dict.fromkeys([name, nick, *aliases, owner.get("organization", "").strip()]) if t]
    extras = ([name, f"{name} 工作", f"{name} 记录"] if name else []) + ([nick] if nick and nick != name else [])
    extras = [t for t in dict.fromkeys([*extras, *aliases, *OWNER_EXTRAS]) if t]
    q = strip("text")
    refers = F.lit(False)
    for word in (*OWNER_PRONOUNS, *OWNER_FIELDS, *terms):
        refers = refers | q.contains(word)
    for term in terms:
        refers = refers | F.lower(q).contains(term.lower())
    rows = queries.where(F.lit(bool(terms)) & (q != "") & refers)
    kept = F.slice(F.filter(F.array(*[F.lit(e) for e in extras]), lambda e: e != q), 1, limit)
    return rows.select("query_id", F.posexplode(kept).alias("position", "text"))


def phrase_dictionary(entries: DataFrame) -> DataFrame:
    """Distinct (name, trigger) rows: the first source of a name wins, its name counts as a trigger too.

    entries: name, source, triggers array, body. Phrases also come from quoted text on lines about triggers."""
    first = first_rows(entries, ["name"], [F.asc("source")])
    lines = F.filter(F.split(F.coalesce("body", F.lit("")), "\n"), lambda s: s.rlike("触发|口令|用户说") & ~(
        s.contains("|") & s.contains("用户说")))
    quoted = F.transform(lines, lambda s: F.regexp_extract(s, "[「\"']([^「\"']{2,40})[」\"']", 1))
    triggers = F.array_distinct(F.filter(F.concat(F.col("triggers"), quoted), lambda s: strip(s) != ""))
    phrases = F.concat(triggers, F.array("name"), F.array(F.replace("name", F.lit("-"), F.lit(" "))))
    return first.select("name", "source", F.explode(F.array_distinct(phrases)).alias("trigger"))


def phrase_dict_match(texts: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """Longest trigger contained in each text, ignoring case; the first name in (source, name) order wins a tie.

    One scan of the texts for a dictionary of any size; only found triggers are shuffled, by the keys."""
    entries = dictionary.select("source", "name", F.lower("trigger").alias("q"), F.length("trigger").alias("n"))
    rows = containing(texts.select(*keys, F.lower(F.col("text")).alias("hay")), "hay", entries, list(keys))
    best = F.min(F.struct((-F.col("n")).alias("neg"), "source", "name"))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.name").alias("name"), (-F.col("b.neg")).alias("length"))


def qa_citation_stats(qa: DataFrame) -> DataFrame:
    listed = F.size(F.coalesce(F.from_json("sources", "array<struct<title string, path string>>"), F.array()))
    return qa.agg(F.count("*").alias("questions"), F.count_if((listed > 0) | (F.col("grounded") == 1)).alias("cited"))


def memory_stats(turns: DataFrame, qa: DataFrame, archived: DataFrame) -> DataFrame:
    """Sessions, turns, questions and archived questions as one row."""
    return turns.agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("turns")).select(
        "*", qa.agg(F.count("*")).scalar().alias("qa_entries"), archived.agg(F.count("*")).scalar().alias("archived"))


def evolution_snapshot(rules: DataFrame, audit: DataFrame, qa: DataFrame, archived: DataFrame, sessions: DataFrame,
                       since: Column) -> DataFrame:
    """Totals, last week's additions and the latest session as one row."""
    total = lambda df, cond=None: df.agg(F.count("*") if cond is None else F.count_if(cond)).scalar()
    latest = sessions.agg(F.max_by(F.struct("session_id", "preview"), F.struct("updated_at", "session_id")).alias("s"))
    return latest.select(
        F.col("s.session_id").alias("last_session_id"), F.col("s.preview").alias("last_session_title"),
        total(rules).alias("rules_total"), total(rules, F.col("enabled")).alias("rules_enabled"),
        total(audit, F.col("action").startswith("rule_create") & (F.col("at_time") >= since)).alias("rules_added"),
        total(qa).alias("qa_entries"), total(qa, F.col("at_time") >= since).alias("qa_added"),
        total(archived).alias("archived"), total(archived, F.col("at_time") >= since).alias("archived_added"),
        total(sessions).alias("sessions"))


def latest_rules(rules: DataFrame, group: str, n: int = 20) -> DataFrame:
    """The last n enabled rules of each group, in order."""
    return top_rows(rules.where("enabled"), [group], [F.desc("ord")], n).drop("rank")


def last_per_day(records: DataFrame, group: str, n: int = 8) -> DataFrame:
    """One record per day, the latest; the newest n days of each group."""
    day = records.groupBy(group, F.date_trunc("DAY", "ts").alias("day")).agg(
        F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("r"))
    return top_rows(day.select(group, "day", "r.*"), [group], [F.desc("day")], n).drop("rank")


def seeded_pick(items: DataFrame, days: list[str], seed: str, n: int) -> DataFrame:
    """n distinct items per day, always the same for a day and seed."""
    spread = items.select("id", F.explode(F.array(*[F.lit(d) for d in days])).alias("day"))
    keyed = spread.withColumn("draw", F.md5(F.concat("day", F.lit(seed), F.col("id").cast("string"))))
    return top_rows(keyed, ["day"], [F.asc("draw"), F.asc("id")], n)


def collapse_repeats(lines: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """Caption lines without markup, cue numbers and times; a line equal to the one before is dropped."""
    clean = lines.withColumn("line", strip("line")).where(
        (F.col("line") != "") & ~F.upper("line").rlike("^(WEBVTT|NOTE)") & ~F.col("line").contains("-->")
        & ~F.col("line").rlike(r"^\d+$"))
    bare = clean.withColumn("line", F.regexp_replace("line", "<[^>]+>", "")).where("line <> ''")
    from .sequences import neighbour

    seen = neighbour(bare, keys, id_block("pos", width), ["pos"], ["line"], "before", following=False)
    return seen.where(F.col("before").isNull() | (F.col("before.line") != F.col("line"))).drop("before")


def number_blocks(tables: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Running number of each table on its page and its label."""
    numbered = running(tables, keys, id_block(order, 4096), [order], sums={"n": F.lit(1)})
    return numbered.withColumn("label", F.format_string("--- 第%d页-表格%d ---", F.col(keys[-1]), F.col("n")))


def run_ledger(runs: DataFrame, by: list[str]) -> DataFrame:
    """Runs, failures and the last error, blank when the last run succeeded."""
    last = F.max_by(F.struct("ok", "error"), F.struct("at_time", "run_id"))
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("failures"), last.alias("l")).select(
        *by, "runs", "failures", F.when(F.col("l.ok"), "").otherwise(F.substring("l.error", 1, 500)).alias("last_error"))


def job_summary(items: DataFrame) -> DataFrame:
    """Progress of each job from its item results (job_id, item, ok, finished, error, at_time).

    Failed only when there are errors and no success; errors themselves stay rows, the last one is shown."""
    done, good = F.col("finished"), F.col("finished") & F.col("ok")
    bad = F.col("finished") & ~F.col("ok")
    rows = items.groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(good).alias("ingested"),
        F.count_if(bad).alias("errors"), F.max_by(F.when(bad, F.col("error")), F.when(bad, F.struct("at_time", "item"))).alias("last_error"))
    status = (F.when(F.col("done") < F.col("total"), "running")
              .when((F.col("errors") > 0) & (F.col("ingested") == 0), "failed").otherwise("done"))
    return rows.withColumn("status", status).withColumn("percent", progress_percent("status", "total", "done"))


def progress_percent(status, total, done, embedding: bool = False) -> Column:
    status, total, done = F.col(status), F.col(total), F.col(done)
    base = F.when(total <= 0, F.when(status == "running", 5).otherwise(0))
    running_part = (F.least(F.lit(99), F.floor(85 + 14 * done / F.greatest(total, F.lit(1)))) if embedding
                    else F.least(F.lit(85), F.floor(85 * done / F.greatest(total, F.lit(1)))))
    return F.when(status == "done", 100).otherwise(F.coalesce(base, running_part)).cast("bigint")


def adoption_funnel(users: DataFrame) -> DataFrame:
    """Milestones of each user from counts, and how many users reached each."""
    steps = {"has_content": F.col("contents") > 0, "asked_with_cite": F.col("cited") > 0, "distilled": F.col("distilled") > 0}
    core = F.col("has_content") & F.col("asked_with_cite")
    rows = users.select(*users.columns[:1], *[c.alias(n) for n, c in steps.items()]).withColumn("core_done", core)
    return rows.withColumns({"week1": F.col("has_content"), "week2": F.col("asked_with_cite"), "week4": F.col("distilled")})


def funnel_counts(rows: DataFrame) -> DataFrame:
    steps = ["has_content", "asked_with_cite", "distilled", "core_done"]
    sums = rows.agg(F.count("*").alias("all"), *[F.count_if(s).alias(s) for s in steps])
    pairs = ", ".join(f"'{s}', `{s}`" for s in ["all", *steps])
    return sums.selectExpr(f"stack({len(steps) + 1}, {pairs}) as (step, users)")


def retrieval_eval(golden: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """1 or 0 per golden query: an expected path part or keyword in the first k hits, or no hit where none is expected."""
    shown = hits.where(F.col("rank") <= k)
    rows = golden.join(shown, "query_id", "left")
    path = (F.coalesce("expect_rel_contains", F.lit("")) != "") & F.col("rel_path").contains(F.col("expect_rel_contains"))
    word = (F.coalesce("expect_keyword", F.lit("")) != "") & F.concat("text", "title").contains(F.col("expect_keyword"))
    found = F.coalesce(F.bool_or(F.coalesce(path, F.lit(False)) | F.coalesce(word, F.lit(False))), F.lit(False))
    per = rows.groupBy("query_id", F.coalesce("expect_empty", F.lit(False)).alias("expect_empty")).agg(
        F.count("chunk_id").alias("hits"), found.alias("found"))
    return per.select("query_id", F.when(F.col("expect_empty"), F.col("hits") == 0).otherwise(F.col("found")).cast("double").alias("recall"))


def search_multi(variants: DataFrame, scored: DataFrame, k: int, threshold: float = 0.08) -> tuple[DataFrame, DataFrame]:
    """Merge the rounds of each query up to the first good one, and the log of the rounds run.

    variants: query_id, round, text. scored: query_id, round, chunk_id, score."""
    log = (variants.join(scored.groupBy("query_id", "round").agg(F.count("*").alias("hits"), F.max("score").alias("top_score")),
                         ["query_id", "round"], "left")
           .select("query_id", "round", F.substring("text", 1, 120).alias("query"), F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
                   F.coalesce("top_score", F.lit(0.0)).alias("top_score")))
    stop = log.where(F.col("top_score") >= threshold).groupBy("query_id").agg(F.min("round").alias("stop"))
    within = F.col("stop").isNull() | (F.col("round") <= F.col("stop"))
    run = log.join(stop, "query_id", "left").where(within).drop("stop")
    kept = scored.join(stop, "query_id", "left").where(within)
    merged = kept.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min_by("round", F.struct(-F.col("score"), "round")).alias("round"))
    return top_rows(merged, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k), run

"""Query understanding: intent, detail, kind of query, retrievers (all as column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X

#: Word patterns of each intent, tried group by group.
FULL_CONTEXT = [r"\beverything\b", r"\ball (about|info|information|details)\b", r"\bfull (history|context|picture|story|details)\b", r"\bcomprehensive\b", r"\bdeep dive\b", r"\bgive me everything\b", r"\bcomplete (overview|picture|history)\b", r"\bthe whole (story|picture|history)\b"]
TEMPORAL = [r"\bwhen\b", r"\blatest\b", r"\brecent\b", r"\bhistory\b", r"\btimeline\b", r"\b[0-9]{4}\b", r"\blast (met|meeting|call)\b", r"\bmeeting notes\b", r"\bwhat'?s new\b", r"\bupdates (on|from|about)\b", r"\bhow long (ago|since)\b", r"\blast (week|month|quarter|year)\b", r"\b[0-9]{4}-[0-9]{2}\b"]
EVENT = [r"\bmeeting\b", r"\blaunch\b", r"\bannounce\b", r"\bevent\b", r"\bfunding\b", r"\bacquisition\b", r"\bannounced\b", r"\bannouncement\b", r"\braised \$[0-9]+\b", r"\bfundraise\b", r"\bipo\b", r"\bmerger\b", r"\bmerged\b", r"\bmerges\b", r"\bnews\b"]
ENTITY = [r"\bwho (is|are|was|were)\b", r"\bwhat (is|are|was|were)\b", r"\btell me about\b", r"\bfind\b", r"\blookup\b", r"\bwhat does\b", r"\bdescribe\b", r"\bsummary\b", r"\bsummarize\b", r"\boverview\b", r"\bbackground\b", r"\bprofile\b"]
#: Retrievers and weights by kind of query.
PLANS = {
    "exact_lookup": {"title_name": 0.5, "metadata": 0.2, "node_fts": 0.2, "vector": 0.15, "passage_fts": 0.1},
    "how_to": {"node_fts": 0.3, "vector": 0.3, "summary": 0.2, "title_name": 0.2, "passage_fts": 0.15},
    "fact_lookup": {"node_fts": 0.4, "vector": 0.3, "metadata": 0.3, "passage_fts": 0.2},
    "conceptual": {"vector": 0.5, "node_fts": 0.3, "summary": 0.2, "passage_fts": 0.1},
    "table_lookup": {"table": 0.5, "node_fts": 0.3, "metadata": 0.2},
    "recent_or_timebound": {"node_fts": 0.4, "metadata": 0.4, "vector": 0.2},
    "small_document": {"title_name": 0.4, "node_fts": 0.3, "vector": 0.3},
}
#: Marks of each kind of query, tried in this order.
TABLE_WORDS, HOW_WORDS, TIME_WORDS, FACT_WORDS = ["表", "sheet", "清单", "xls", "xlsx", "csv", "汇总"], ["怎么", "如何", "流程", "步骤"], ["年", "月", "日", "最近", "去年", "上季度", "q1", "q2"], ["是什么", "定义"]


def any_pattern(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def intent(c: Column | str) -> Column:
    """temporal, event, entity or general."""
    q = F.lower(F.col(c) if isinstance(c, str) else c)
    return X.ladder([(q.rlike(any_pattern(FULL_CONTEXT)), "temporal"), (q.rlike(any_pattern(TEMPORAL)), "temporal"), (q.rlike(any_pattern(EVENT)), "event"), (q.rlike(any_pattern(ENTITY)), "entity")], "general")


def detail(i: Column) -> Column:
    """The level of detail an intent asks for; none for general."""
    return F.when(i == "entity", "low").when(i.isin("temporal", "event"), "high")


def strategy(i: Column) -> Column:
    """Which route answers first."""
    return F.when(i.isin("temporal", "event"), "timeline_first").when(i == "entity", "brain_first").otherwise("evidence_first")


def query_type(c: Column | str) -> Column:
    """One of six kinds of query."""
    q = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))

    def has(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | q.contains(w)
        return out

    fact = has(FACT_WORDS) | q.endswith("?") | q.endswith("？")
    return X.ladder([(has(TABLE_WORDS), "table_lookup"), (has(HOW_WORDS), "how_to"), (has(TIME_WORDS), "recent_or_timebound"), (fact, "fact_lookup"), (X.is_exact_lookup(q), "exact_lookup")], "conceptual")


def plan_table(df: DataFrame) -> DataFrame:
    """query_type, retriever, weight (R29): a table whose size is fixed here."""
    rows = [(k, r, w) for k, v in PLANS.items() for r, w in v.items()]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "query_type string, retriever string, weight double"))


def retrievers(queries: DataFrame, text: str = "text") -> DataFrame:
    """queries with their kind and one row per retriever."""
    typed = queries.withColumn("query_type", query_type(text))
    return typed.join(plan_table(queries), "query_type")

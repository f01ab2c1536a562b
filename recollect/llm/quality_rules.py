"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a Catalyst expression over the text, so the whole check is a
narrow map over the scan: no Python, no shuffle, nothing broadcast. The table
of rules is data (``RULES``); ``compile_rules`` turns it into columns.

Defined results: a null or blank text has zero words, all ratios 0.0, and
fails ``min_words``. The ratio rules apply only from the number of words named in the rule
(``from_words``), because a ratio of a four-word text says nothing. Texts of
any length are read whole. Repeated rows each get their own verdict. Columns of the input that
clash with a metric are replaced in ``score`` and untouched in ``keep_clean``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.rows import free

STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in is it that this was for on are with as by at be from an a or which "
            "der die das und ist den von zu mit auf für ein eine nicht des im dem es sich auch "
            "le la les de et un une en du que qui est dans pour par sur au avec il elle "
            "el los las y del se por con para una su al lo como más".split()
        )
    )
)
#: Stop words as they stand between blanks: plain or capitalised, bare or before a comma or stop.
STOP_FORMS = tuple(sorted({form + end for w in STOP_WORDS for form in (w, w.capitalize(), w.upper()) for end in ("", ",", ".")}))
SYMBOLS = "[#$%&*!|{}<>~^=@]"
BLANK = "[ \\t\\n\\r\\f]+"
UPPER = "\\p{Lu}"


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high] once the text has ``from_words`` words."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("min_words", "n_words", low=1),
    Rule("max_words", "n_words", high=1_000_000),
    Rule("word_length", "mean_word_length", low=2.0, high=14.0, from_words=20),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("stop_words", "stop_ratio", low=0.05, from_words=20),
    Rule("upper_case", "upper_ratio", high=0.5, from_words=8),
    Rule("stutter", "stutter_ratio", high=0.25, from_words=8),
    Rule("duplicate_lines", "duplicate_line_ratio", high=0.6),
    Rule("bullet_lines", "bullet_line_ratio", high=0.9, from_words=20),
    Rule("ellipsis_lines", "ellipsis_line_ratio", high=0.5, from_words=20),
)
METRICS = (
    "n_words",
    "mean_word_length",
    "symbol_ratio",
    "stop_ratio",
    "upper_ratio",
    "stutter_ratio",
    "duplicate_line_ratio",
    "bullet_line_ratio",
    "ellipsis_line_ratio",
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def parts(text: Column, names: tuple[str, str, str]) -> dict[str, Column]:
    """The body, its words and its lines, which several metrics share. They stay in a projection of their own, so each is built once a row."""
    body = F.coalesce(text, F.lit(""))
    made = (body, F.filter(F.split(body, BLANK), lambda w: w != ""), F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return dict(zip(names, made))


def score(docs: DataFrame, text: str = "text", barrier: str | None = None) -> DataFrame:
    """``docs`` with the metric columns, ``failed`` (comma-joined rule names) and ``keep``.

    ``barrier`` names an added column that the optimiser may not move a filter
    below; else a filter on ``keep`` would be rewritten in terms of the text and
    split it anew for every rule.
    """
    body, words, lines = (free(docs, x) for x in ("body", "words", "lines"))
    shared = parts(F.col(text), (body, words, lines))
    df = docs.withColumns(shared)
    n_words, n_lines, chars = F.size(words), F.size(lines), F.length(F.array_join(words, ""))
    stutter = F.size(F.filter(words, lambda w, i: w == F.get(F.col(words), i - 1)))
    stop = F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS)))
    bullets = F.size(F.filter(lines, lambda x: F.substring(x, 1, 1).isin("-", "*", "•")))
    dots = F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…")))
    out = df.withColumns(
        {
            "n_words": n_words.cast("bigint"),
            "mean_word_length": _ratio(chars, n_words),
            "symbol_ratio": _ratio(F.regexp_count(body, F.lit(SYMBOLS)), n_words),
            "stop_ratio": _ratio(stop, n_words),
            "upper_ratio": _ratio(F.regexp_count(body, F.lit(UPPER)), chars),
            "stutter_ratio": _ratio(stutter, n_words),
            "duplicate_line_ratio": _ratio(n_lines - F.size(F.array_distinct(lines)), n_lines),
            "bullet_line_ratio": _ratio(bullets, n_lines),
            "ellipsis_line_ratio": _ratio(dots, n_lines),
        }
        | ({barrier: F.monotonically_increasing_id()} if barrier else {})
    ).drop(*shared)
    return out.withColumns({"failed": failed(), "keep": failed() == ""})


def failed(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules a row breaks, in table order."""
    broken = []
    for rule in rules:
        value = F.col(rule.metric)
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        if rule.from_words:
            bad = bad & (F.col("n_words") >= rule.from_words)
        broken.append(F.when(bad, F.lit(rule.name)))
    return F.concat_ws(",", *broken)


def keep_clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that break no rule, with the columns of ``docs``.

    The verdict is computed beside the row (packed in a struct) so that input
    columns named like metrics survive.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col("text"))
    return score(packed, barrier="_row").where(F.col("keep") & (F.col("_row") >= 0)).select("row.*")


def _sql_list(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _sql_failed(rules: tuple[Rule, ...] = RULES) -> str:
    cases = []
    for rule in rules:
        bad = " OR ".join(
            x
            for x in (
                f"{rule.metric} < {rule.low}" if rule.low is not None else "",
                f"{rule.metric} > {rule.high}" if rule.high is not None else "",
            )
            if x
        )
        cases.append(f"CASE WHEN ({bad}) AND n_words >= {rule.from_words} THEN '{rule.name}' END")
    return f"concat_ws(',', {', '.join(cases)})"


SQL = f"""
WITH parts AS (
  SELECT doc_id, body,
    list_filter(regexp_split_to_array(body, '[ \\t\\n\\r\\f]+'), lambda w: w <> '') AS words,
    list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
), c AS (SELECT *, len(words) AS nw, len(lines) AS nl, length(array_to_string(words, '')) AS chars FROM parts
), m AS (
  SELECT doc_id, CAST(nw AS BIGINT) AS n_words,
    CASE WHEN nw > 0 THEN round(chars / nw, 6) ELSE 0.0 END AS mean_word_length,
    CASE WHEN nw > 0 THEN round((length(body) - length(regexp_replace(body, '{SYMBOLS}', '', 'g'))) / nw, 6) ELSE 0.0 END AS symbol_ratio,
    CASE WHEN nw > 0 THEN round(len(list_filter(words, lambda w: w IN ({_sql_list(STOP_FORMS)}))) / nw, 6) ELSE 0.0 END AS stop_ratio,
    CASE WHEN chars > 0 THEN round((length(body) - length(regexp_replace(body, '{UPPER}', '', 'g'))) / chars, 6) ELSE 0.0 END AS upper_ratio,
    CASE WHEN nw > 0 THEN round(len(list_filter(list_zip(words, words[2:]), lambda z: z[1] = z[2])) / nw, 6) ELSE 0.0 END AS stutter_ratio,
    CASE WHEN nl > 0 THEN round((nl - len(list_distinct(lines))) / nl, 6) ELSE 0.0 END AS duplicate_line_ratio,
    CASE WHEN nl > 0 THEN round(len(list_filter(lines, lambda x: substr(x, 1, 1) IN ('-', '*', '•'))) / nl, 6) ELSE 0.0 END AS bullet_line_ratio,
    CASE WHEN nl > 0 THEN round(len(list_filter(lines, lambda x: x LIKE '%...' OR x LIKE '%…')) / nl, 6) ELSE 0.0 END AS ellipsis_line_ratio
  FROM c
)
SELECT *, {_sql_failed()} AS failed, {_sql_failed()} = '' AS keep FROM m
"""

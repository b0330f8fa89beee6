"""Queries of the engine over the shared tables, each with the same result in DuckDB SQL.

Streams are conversations: a turn is an append. Texts are documents. Probabilities come from the
hash scorer, so that SQL can repeat them, and gold entities from a hash of word numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import buffer as B
from ..operators import metrics as M
from ..operators import policies as P
from ..operators import resolve as R
from ..operators import revisions as V
from ..operators import selection as S
from ..operators import specs as G
from ..operators import sweep as X
from ..operators import updates as U
from ..sources import tables as corpus
from ..sources import traces
from ..sources.tables import conversation_steps, table
from ..streaming import commits as stream_

#: Turns are long, so the window that is scored again reaches back 100 words.
HOW = U.Scoring(right_context=100)
TAU = 0.8


@dataclass(frozen=True)
class Stream:
    """Everything a query needs of the conversations; plans only, nothing runs until a result is asked for."""

    steps: DataFrame
    words: DataFrame
    updates: DataFrame
    obs: DataFrame
    states: DataFrame
    gold: DataFrame


def stream(spark: SparkSession, sf_dir: str) -> Stream:
    steps = U.with_word_counts(conversation_steps(table(spark, sf_dir, "conversations")))
    words = U.stream_words(steps)
    updates = U.span_updates(U.hash_scorer(U.candidates(steps, HOW), HOW), HOW)
    obs = U.observations(updates, HOW)
    states = U.candidate_states(obs, steps)
    return Stream(steps, words, updates, obs, states, gold_entities(words))


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once where all executors reach them, for what is used several times; nothing stays in memory."""
    path = f"{stream_.shared_folder(df.sparkSession)}/kept"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def gold_entities(words: DataFrame) -> DataFrame:
    """One word in ten begins an entity of one to three words; the label follows its parity."""
    order, length = Window.partitionBy("example_id").orderBy("word_index"), F.col("word_index") % 3
    ends = F.when(length == 0, F.col("end_char")).when(length == 1, F.lead("end_char", 1).over(order)).otherwise(F.lead("end_char", 2).over(order))
    rows = words.withColumn("end_char", ends).where((U.hash_probability(F.lit("gold"), F.col("example_id"), F.col("word_index")) < 0.1) & F.col("end_char").isNotNull())
    return rows.select("example_id", (F.col("word_index") + length).alias("end_word"), F.col("word_index").alias("start_word"), "start_char", F.when(F.col("word_index") % 2 == 0, "person").otherwise("place").alias("label"), "end_char")


def spans_in_chars(spans: DataFrame, words: DataFrame) -> DataFrame:
    a = words.select("example_id", F.col("word_index").alias("start_word"), "start_char")
    b = words.select("example_id", F.col("word_index").alias("end_word"), "end_char")
    return spans.join(a, ["example_id", "start_word"]).join(b, ["example_id", "end_word"])


def _ready(s: Stream, policy: str) -> DataFrame:
    if policy == "fixed_threshold":
        return P.fixed_threshold(s.states, TAU)
    if policy == "fixed_lag":
        return P.fixed_lag(s.states, TAU, 4)
    if policy == "snapshot_patience":
        return P.snapshot_patience(s.states, TAU, 2)
    if policy == "rescore_patience":
        return P.rescore_patience(s.states, 0.5, 2)
    if policy == "ema":
        return P.ema(s.states, 0.7, 0.5)
    if policy == "stability_gate":
        return P.stability_gate(P.gate_features(s.states), 0.6, epsilon=0.5, min_margin=0.1, max_extension=0.3)
    if policy == "edge_buffer":
        return B.edge_buffer(s.states, TAU, 2, steps=s.steps)
    return P.oracle_stable(s.states, TAU, look_ahead=True)


def _first(s: Stream, policy: str) -> DataFrame:
    """Ready rows among which is the first of every candidate: score events where they are enough."""
    if policy == "fixed_threshold":
        return P.fixed_threshold(s.obs, TAU)
    if policy == "rescore_patience":
        return P.rescore_patience(s.obs, 0.5, 2)
    if policy == "ema":
        return P.first_ema(s.obs, 0.7, 0.5)
    return _ready(s, policy)


POLICIES = ("fixed_threshold", "fixed_lag", "snapshot_patience", "rescore_patience", "ema", "stability_gate", "oracle_stable", "edge_buffer")

# --- SQL ---------------------------------------------------------------------------------

_SPACE = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
_UNIT = rf"[^{_SPACE}]+"
_WORD = rf"[\p{{L}}\p{{N}}_]+(?:[-_][\p{{L}}\p{{N}}_]+)*|[^{_SPACE}]"
_CHUNK = rf"(?:^[{_SPACE}]*)?(?:{_UNIT}[{_SPACE}]*){{1,8}}|^[{_SPACE}]+$"
_HASH = "CAST(('0x' || substr(md5(concat_ws('|', {})), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
_LABELS = "['person', 'place']"

_STEPS = rf"""
st0 AS (SELECT conv_id AS example_id, turn, role, coalesce(text, '') || chr(10) AS chunk FROM conversations),
st1 AS (SELECT example_id, row_number() OVER o AS step, chunk,
        CAST(sum(length(chunk)) OVER (PARTITION BY example_id ORDER BY turn, role, chunk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visible_char_count,
        len(regexp_extract_all(chunk, '{_WORD}')) AS new_words
        FROM st0 WINDOW o AS (PARTITION BY example_id ORDER BY turn, role, chunk)),
steps AS (SELECT example_id, step, chunk, visible_char_count, visible_char_count - length(chunk) AS first_char,
          CAST(sum(new_words) OVER (PARTITION BY example_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visible_word_count, new_words FROM st1),
tk AS (SELECT example_id, step, first_char, unnest(regexp_extract_all(chunk, '{_WORD}')) AS word,
       unnest(regexp_split_to_array(chunk, '{_WORD}')) AS gap, generate_subscripts(regexp_split_to_array(chunk, '{_WORD}'), 1) AS i FROM steps),
words AS (SELECT example_id, step, row_number() OVER (PARTITION BY example_id ORDER BY step, i) - 1 AS word_index, word,
          CAST(first_char + sum(length(gap) + length(word)) OVER (PARTITION BY example_id, step ORDER BY i ROWS UNBOUNDED PRECEDING) - length(word) AS BIGINT) AS start_char,
          CAST(first_char + sum(length(gap) + length(word)) OVER (PARTITION BY example_id, step ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_char
          FROM tk WHERE word IS NOT NULL)"""
_UPDATES = _STEPS + rf""",
ends AS (SELECT example_id, step, visible_word_count, unnest(range(least(visible_word_count - new_words, greatest(0, visible_word_count - 1 - 100)), visible_word_count)) AS end_word
         FROM steps WHERE new_words > 0),
cand AS (SELECT example_id, step, visible_word_count, unnest(range(greatest(0, end_word - 2), end_word + 1)) AS start_word, end_word FROM ends),
scored AS (SELECT *, [{_HASH.format("example_id, start_word, end_word, 'person', step")}, {_HASH.format("example_id, start_word, end_word, 'place', step")}] AS probs FROM cand),
updates AS (SELECT example_id, step, visible_word_count, start_word, end_word, probs,
            CAST(list_position(probs, list_max(probs)) - 1 AS BIGINT) AS top_label_index, {_LABELS}[list_position(probs, list_max(probs))] AS top_label,
            list_max(probs) AS top_probability, list_min(probs) AS second_probability, list_max(probs) - list_min(probs) AS label_margin,
            lag(list_max(probs)) OVER s AS previous_top_probability, list_max(probs) - lag(list_max(probs)) OVER s AS top_probability_delta,
            CASE WHEN lag(list_max(probs)) OVER s IS NULL THEN 'new' ELSE 'rescore' END AS update_kind, visible_word_count - 1 - end_word AS tail_distance_words
            FROM scored WINDOW s AS (PARTITION BY example_id, start_word, end_word ORDER BY step))"""
_OBS = _UPDATES + rf""",
ob0 AS (SELECT example_id, step, start_word, end_word, unnest({_LABELS}) AS label, unnest(probs) AS probability FROM updates),
obs AS (SELECT *, row_number() OVER k AS rescore_count, lag(probability) OVER k AS previous, probability - lag(probability) OVER k AS delta, lead(step) OVER k AS next_step
        FROM ob0 WINDOW k AS (PARTITION BY example_id, start_word, end_word, label ORDER BY step)),
obr AS (SELECT *, list(delta) FILTER (delta IS NOT NULL) OVER (PARTITION BY example_id, start_word, end_word, label ORDER BY step ROWS 2 PRECEDING) AS rolling FROM obs),
states AS (SELECT o.example_id, s.step, start_word, end_word, label, probability, rescore_count, s.step - o.step AS snapshot_age, s.step = o.step AS was_rescored,
           s.visible_word_count - 1 - end_word AS tail_distance_words, rolling
           FROM obr o JOIN steps s ON o.example_id = s.example_id AND s.step >= o.step AND (next_step IS NULL OR s.step < next_step))"""
_GOLD = rf""",
gold AS (SELECT a.example_id, a.word_index AS start_word, b.word_index AS end_word, a.start_char, b.end_char, CASE WHEN a.word_index % 2 = 0 THEN 'person' ELSE 'place' END AS label
         FROM words a JOIN words b ON a.example_id = b.example_id AND b.word_index = a.word_index + a.word_index % 3
         WHERE {_HASH.format("'gold', a.example_id, a.word_index")} < 0.1)"""
_K = "example_id, start_word, end_word, label"

_READY = {
    "fixed_threshold": f"ready AS (SELECT {_K}, step, probability, probability AS readiness FROM states WHERE probability >= 0.8)",
    "fixed_lag": f"ready AS (SELECT {_K}, step, probability, probability AS readiness FROM states WHERE probability >= 0.8 AND tail_distance_words >= 4)",
    "snapshot_patience": f"""runs AS (SELECT *, sum(CASE WHEN probability < 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY {_K} ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM states),
held AS (SELECT *, row_number() OVER (PARTITION BY {_K}, run ORDER BY step) AS held FROM runs WHERE probability >= 0.8),
ready AS (SELECT {_K}, step, probability, probability AS readiness FROM held WHERE held >= 2)""",
    "rescore_patience": f"ready AS (SELECT {_K}, step, probability, probability AS readiness FROM states WHERE probability >= 0.5 AND rescore_count >= 2)",
    "ema": f"""sc AS (SELECT *, list(probability) FILTER (was_rescored) OVER (PARTITION BY {_K} ORDER BY step ROWS UNBOUNDED PRECEDING) AS scores FROM states),
em AS (SELECT *, list_reduce(scores, lambda e, p: p * 0.5::DOUBLE + e * 0.5::DOUBLE) AS ema FROM sc),
ready AS (SELECT {_K}, step, probability, ema AS readiness FROM em WHERE ema >= 0.7)""",
    "stability_gate": f"""gate AS (SELECT *, coalesce(list_max(list_transform(rolling, lambda d: abs(d))), 0.0) AS instability,
max(probability) OVER b - min(probability) OVER b AS label_margin,
coalesce(max(probability) OVER (PARTITION BY example_id, step, start_word, label ORDER BY end_word ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - probability, 0.0) AS extension_advantage
FROM states WINDOW b AS (PARTITION BY example_id, step, start_word, end_word)),
ready AS (SELECT {_K}, step, probability, probability AS readiness FROM gate WHERE probability >= 0.6 AND instability <= 0.5 AND label_margin >= 0.1 AND extension_advantage <= 0.3)""",
    "edge_buffer": f"""eb AS (SELECT *, max(step) OVER (PARTITION BY example_id) AS last_step,
min(CASE WHEN probability >= 0.8 AND tail_distance_words = 0 THEN step END) OVER (PARTITION BY example_id, start_word ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM states),
ready AS (SELECT {_K}, step, probability, probability AS readiness FROM eb WHERE probability >= 0.8 AND (since IS NULL OR step >= since + 2 OR step = last_step))""",
    "oracle_stable": f"""lo AS (SELECT *, max(step) FILTER (probability < 0.8) OVER (PARTITION BY {_K}) AS low FROM states),
ready AS (SELECT {_K}, step, probability, probability AS readiness FROM lo WHERE low IS NULL OR step > low)""",
}
_COMMITS = f"""first AS (SELECT {_K}, min(step) AS step, arg_min(probability, step) AS probability, arg_min(readiness, step) AS readiness FROM ready GROUP BY ALL),
ranked AS (SELECT example_id, list({{'step': step, 'r': -readiness, 'p': -probability, 'start_word': start_word, 'end_word': end_word, 'label': label}}
           ORDER BY step, -readiness, -probability, start_word, end_word, label) AS rows FROM first GROUP BY example_id),
folded AS (SELECT example_id, list_reduce(list_transform(rows, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.start_word <= x[1].end_word AND x[1].start_word <= k.end_word)) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept FROM ranked),
un AS (SELECT example_id, unnest(kept) AS k FROM folded),
commits AS (SELECT example_id, k.start_word AS start_word, k.end_word AS end_word, k.label AS label, k.step AS step, -k.r AS readiness FROM un)"""
_FIXED = _OBS + _GOLD + ", " + _READY["fixed_threshold"] + ", " + _COMMITS


def _with(ctes: str, select: str) -> str:
    return f"WITH {'RECURSIVE ' if ' FROM sf WHERE kept' in ctes else ''}{ctes.strip()}\n{select}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- text --------------------------------------------------------------------------------


@_query("word_counts", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_UNIT}')) AS BIGINT) AS n_units, CAST(len(regexp_extract_all(text, '{_WORD}')) AS BIGINT) AS n_words FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.count_units("text").alias("n_units"), tx.count_words("text").alias("n_words"))


@_query("chunks", f"WITH c AS (SELECT doc_id, regexp_extract_all(text, '{_CHUNK}') AS l FROM documents) SELECT doc_id, unnest(l) AS chunk, generate_subscripts(l, 1) AS step FROM c")
def chunks(spark, sf_dir):
    return tx.chunks(table(spark, sf_dir, "documents"), ["doc_id"], "text", 8).select("doc_id", "chunk", "step")


@_query("stream_words", _with(_STEPS, "SELECT * FROM words"))
def stream_words(spark, sf_dir):
    return stream(spark, sf_dir).words


# --- events and states -------------------------------------------------------------------

_UPDATE_COLUMNS = "example_id, step, start_word, end_word, top_label, top_probability, second_probability, label_margin, previous_top_probability, top_probability_delta, update_kind, tail_distance_words"


@_query("candidates", _with(_UPDATES, "SELECT example_id, step, visible_word_count, start_word, end_word FROM cand"))
def candidates(spark, sf_dir):
    return U.candidates(stream(spark, sf_dir).steps, HOW)


@_query("span_updates", _with(_UPDATES, f"SELECT {_UPDATE_COLUMNS} FROM updates"))
def span_updates(spark, sf_dir):
    return stream(spark, sf_dir).updates.selectExpr(*_UPDATE_COLUMNS.split(", "))


@_query("replay_state", _with(_UPDATES, "SELECT example_id, start_word, end_word, arg_max(probs, step)[1] AS p_person, arg_max(probs, step)[2] AS p_place, max(step) AS last_step FROM updates WHERE step <= 2 GROUP BY ALL"))
def replay_state(spark, sf_dir):
    return U.replay(stream(spark, sf_dir).updates, 2).select("example_id", "start_word", "end_word", F.col("probs")[0].alias("p_person"), F.col("probs")[1].alias("p_place"), "last_step")


@_query("trajectories", _with(_OBS, f"SELECT {_K}, step, probability, rescore_count, previous, delta, coalesce(list_sum(rolling), 0.0) AS rolling_sum FROM obr"))
def trajectories(spark, sf_dir):
    return stream(spark, sf_dir).obs.select(*P.KEY, "step", "probability", "rescore_count", "previous", "delta", F.aggregate("rolling_deltas", F.lit(0.0), lambda a, d: a + d).alias("rolling_sum"))


@_query("families", _with(_OBS, "SELECT example_id, start_word, label, array_to_string(list_sort(list_distinct(list(end_word))), ',') AS end_words, max(end_word) AS longest_end_word FROM obs GROUP BY example_id, start_word, label"))
def families(spark, sf_dir):
    return U.families(stream(spark, sf_dir).obs).withColumn("end_words", F.array_join(F.transform("end_words", lambda w: w.cast("string")), ","))


@_query("overlap_components", _with(_OBS, """, sp AS (SELECT DISTINCT example_id, label, start_word, end_word FROM obs),
op AS (SELECT *, CASE WHEN max(end_word) OVER w IS NULL OR start_word > max(end_word) OVER w THEN 1 ELSE 0 END AS opens FROM sp
       WINDOW w AS (PARTITION BY example_id, label ORDER BY start_word, end_word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
co AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY example_id, label ORDER BY start_word, end_word ROWS UNBOUNDED PRECEDING) AS BIGINT) AS component FROM op)
SELECT example_id, label, component, min(start_word) AS first_word, max(end_word) AS last_word, count(*) AS spans FROM co GROUP BY ALL"""))
def overlap_components(spark, sf_dir):
    return U.overlap_components(stream(spark, sf_dir).obs)


@_query("candidate_states", _with(_OBS, f"SELECT {_K}, step, probability, rescore_count, snapshot_age, was_rescored, tail_distance_words FROM states"))
def candidate_states(spark, sf_dir):
    return stream(spark, sf_dir).states.select(*P.KEY, "step", "probability", "rescore_count", "snapshot_age", "was_rescored", "tail_distance_words")


def _add_policy(name: str) -> None:
    base = _OBS + ", " + _READY[name]

    @_query(f"ready_{name}", _with(base, f"SELECT {_K}, min(step) AS step, arg_min(readiness, step) AS readiness FROM ready GROUP BY ALL"))
    def ready(spark, sf_dir):
        return P.first_ready(_first(stream(spark, sf_dir), name)).select(*P.KEY, "step", "readiness")

    @_query(f"commits_{name}", _with(base + ", " + _COMMITS, "SELECT * FROM commits"))
    def committed(spark, sf_dir):
        return R.commits(_first(stream(spark, sf_dir), name))


for _name in POLICIES:
    _add_policy(_name)


@_query("gate_features", _with(_OBS + ", " + _READY["stability_gate"], f"SELECT {_K}, step, probability, rescore_count, tail_distance_words, instability, label_margin, extension_advantage FROM gate"))
def gate_features(spark, sf_dir):
    return P.gate_features(stream(spark, sf_dir).states)


@_query("blocked_revisions", _with(_FIXED, f"SELECT example_id, count(*) AS blocked_revisions FROM ready ANTI JOIN commits USING ({_K}) GROUP BY example_id"))
def blocked_revisions(spark, sf_dir):
    s = stream(spark, sf_dir)
    return R.blocked_revisions(_ready(s, "fixed_threshold"), R.commits(_first(s, "fixed_threshold")))


@_query("block_reasons", _with(_FIXED, f""", bl AS (SELECT r.*, min({{'at': c.step, 'start': c.start_word}}) AS o FROM (SELECT {_K}, step FROM ready ANTI JOIN commits USING ({_K})) r
JOIN commits c ON r.example_id = c.example_id AND r.start_word <= c.end_word AND c.start_word <= r.end_word AND c.step <= r.step GROUP BY ALL)
SELECT {_K}, step, CASE WHEN o.at < step THEN 'committed_overlap' ELSE 'ready_overlap' END AS reason, o.start AS blocker_start, o.at AS blocker_step FROM bl"""))
def block_reasons(spark, sf_dir):
    s = stream(spark, sf_dir)
    return R.block_reasons(_ready(s, "fixed_threshold"), R.commits(_first(s, "fixed_threshold")))


@_query("stream_commits", _with(_OBS + ", " + _READY["fixed_threshold"] + ", " + _COMMITS, "SELECT *, 'live' AS phase FROM commits"))
def stream_commits(spark, sf_dir):
    """The commits of the threshold policy from a Structured Streaming query."""
    folder = stream_.shared_folder(spark)
    ready = P.first_ready(_first(stream(spark, sf_dir), "fixed_threshold"))
    ready.write.parquet(f"{folder}/ready")
    return stream_.run_available(spark, f"{folder}/ready", f"{folder}/commits", f"{folder}/checkpoint")


_FAULTY = _UPDATES + """,
fs AS (SELECT example_id, step + CASE WHEN example_id % 5 = 0 AND step >= 3 THEN 1 ELSE 0 END AS step, chunk, CASE WHEN example_id % 7 = 0 AND step = 2 THEN 0 ELSE visible_char_count END AS visible_char_count,
CASE WHEN example_id % 11 = 0 AND step = 3 THEN 1 ELSE visible_word_count END AS visible_word_count FROM steps),
fo AS (SELECT *, row_number() OVER o AS number, lag(visible_char_count) OVER o AS was, lag(visible_word_count) OVER o AS words_were FROM fs WINDOW o AS (PARTITION BY example_id ORDER BY step)),
fu AS (SELECT example_id, CASE WHEN start_word = 3 THEN step + 1000 ELSE step END AS step, CASE WHEN start_word = 7 THEN end_word + 1 ELSE start_word END AS start_word, CASE WHEN start_word = 5 THEN end_word + 100000 ELSE end_word END AS end_word,
start_word = 11 AS bad, unnest(CASE WHEN start_word = 9 THEN [1, 2] ELSE [1] END) AS copy FROM updates),
fj AS (SELECT fu.*, fs.visible_word_count AS seen FROM fu LEFT JOIN fs USING (example_id, step))"""


@_query("trace_violations", _with(_FAULTY, """SELECT 'step_gap' AS rule, example_id, step FROM fo WHERE step <> number UNION ALL SELECT 'text_shrinks', example_id, step FROM fo WHERE visible_char_count < was
UNION ALL SELECT 'words_shrink', example_id, step FROM fo WHERE visible_word_count < words_were UNION ALL SELECT 'chunk_length', example_id, step FROM fo WHERE visible_char_count - coalesce(was, 0) <> length(chunk)
UNION ALL SELECT 'unknown_step', example_id, step FROM fj WHERE seen IS NULL UNION ALL SELECT 'word_order', example_id, step FROM fj WHERE start_word < 0 OR end_word < start_word
UNION ALL SELECT 'unseen_word', example_id, step FROM fj WHERE end_word >= seen UNION ALL SELECT 'probability', example_id, step FROM fj WHERE bad
UNION ALL SELECT 'scored_twice', example_id, step FROM (SELECT example_id, step, start_word, end_word FROM fu GROUP BY ALL HAVING count(*) > 1)"""))
def trace_violations(spark, sf_dir):
    """A log that breaks every rule somewhere: steps with gaps and shrinking text, and score events moved, turned round, repeated and out of range."""
    s = stream(spark, sf_dir)
    put = lambda name, when, value: F.when(when, value).otherwise(F.col(name)).alias(name)
    at, start, conv = F.col("step"), F.col("start_word"), F.col("example_id")
    steps = s.steps.select(
        "example_id",
        put("step", (conv % 5 == 0) & (at >= 3), at + 1),
        "chunk",
        put("visible_char_count", (conv % 7 == 0) & (at == 2), F.lit(0)),
        put("visible_word_count", (conv % 11 == 0) & (at == 3), F.lit(1)),
    )
    updates = s.updates.select(
        "example_id",
        put("step", start == 3, at + 1000),
        put("start_word", start == 7, F.col("end_word") + 1),
        put("end_word", start == 5, F.col("end_word") + 100_000),
        F.when(start == 11, F.array(F.lit(1.5), F.lit(None))).otherwise(F.col("probs")).alias("probs"),
        F.explode(F.when(start == 9, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return traces.violations(steps, updates)


# --- metrics -----------------------------------------------------------------------------


def _fixed(spark, sf_dir) -> tuple[Stream, DataFrame]:
    s = stream(spark, sf_dir)
    return s, R.commits(_first(s, "fixed_threshold"))


_STRICT = f""", pr AS (SELECT DISTINCT {_K}, 1 AS p FROM commits), gr AS (SELECT DISTINCT {_K}, 1 AS g FROM gold),
counts AS (SELECT example_id, count(*) FILTER (p IS NOT NULL AND g IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn
FROM pr FULL JOIN gr USING ({_K}) GROUP BY example_id)"""


@_query("strict_counts", _with(_FIXED, _STRICT + "SELECT * FROM counts"))
def strict_counts(spark, sf_dir):
    s, c = _fixed(spark, sf_dir)
    return M.strict_counts(c, s.gold)


@_query("task_scores", _with(_FIXED, _STRICT + """, t AS (SELECT 'task' || example_id % 4 AS task, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM counts GROUP BY ALL),
a AS (SELECT * FROM t UNION ALL SELECT '__overall__', sum(tp), sum(fp), sum(fn) FROM t),
pr2 AS (SELECT task, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS r FROM a),
f AS (SELECT task, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr2)
SELECT task, round(p, 9) AS "precision", round(r, 9) AS recall, round(f1, 9) AS f1 FROM f
UNION ALL SELECT '__macro__', round(avg(p), 9), round(avg(r), 9), round(avg(f1), 9) FROM f WHERE task <> '__overall__'"""))
def task_scores(spark, sf_dir):
    s, c = _fixed(spark, sf_dir)
    counts = M.strict_counts(c, s.gold).withColumn("task", F.concat(F.lit("task"), F.col("example_id") % 4))
    return M.task_scores(counts).select("task", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


_UNION = """{0} AS (WITH o AS (SELECT *, CASE WHEN max(end_char) OVER w IS NULL OR start_char > max(end_char) OVER w THEN 1 ELSE 0 END AS opens FROM {1}
WINDOW w AS (PARTITION BY example_id ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY example_id ORDER BY start_char, end_char ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT example_id, min(start_char) AS start_char, max(end_char) AS end_char FROM i GROUP BY example_id, island)"""


@_query("gold_intervals", _with(_STEPS + _GOLD + ", " + _UNION.format("gu", "gold"), "SELECT * FROM gu"))
def gold_intervals(spark, sf_dir):
    return M.merge_intervals(stream(spark, sf_dir).gold, ["example_id"])


@_query("masking_counts", _with(_FIXED + """, cc AS (SELECT c.example_id, a.start_char, b.end_char FROM commits c JOIN words a ON a.example_id = c.example_id AND a.word_index = c.start_word
JOIN words b ON b.example_id = c.example_id AND b.word_index = c.end_word), """ + _UNION.format("pu", "cc") + ", " + _UNION.format("gu", "gold"),
"""SELECT t.example_id, t.text_length, coalesce(p.n, 0) AS predicted_chars, coalesce(g.n, 0) AS gold_chars, coalesce(m.n, 0) AS tp_chars, t.text_length - coalesce(g.n, 0) AS non_pii_chars
FROM (SELECT example_id, max(visible_char_count) AS text_length FROM steps GROUP BY 1) t
LEFT JOIN (SELECT example_id, CAST(sum(end_char - start_char) AS BIGINT) AS n FROM pu GROUP BY 1) p USING (example_id)
LEFT JOIN (SELECT example_id, CAST(sum(end_char - start_char) AS BIGINT) AS n FROM gu GROUP BY 1) g USING (example_id)
LEFT JOIN (SELECT p.example_id, CAST(sum(least(p.end_char, g.end_char) - greatest(p.start_char, g.start_char)) AS BIGINT) AS n FROM pu p JOIN gu g
ON p.example_id = g.example_id AND p.start_char < g.end_char AND g.start_char < p.end_char GROUP BY 1) m USING (example_id)"""))
def masking_counts(spark, sf_dir):
    s, c = _fixed(spark, sf_dir)
    lengths = s.steps.groupBy("example_id").agg(F.max("visible_char_count").alias("text_length"))
    return M.masking_counts(spans_in_chars(c, s.words), s.gold, lengths)


@_query("outcomes", _with(_FIXED, f""", c2 AS (SELECT example_id, count(*) AS commits, count(g.hit) AS correct FROM commits c LEFT JOIN (SELECT DISTINCT {_K}, 1 AS hit FROM gold) g USING ({_K}) GROUP BY example_id),
g2 AS (SELECT example_id, count(*) AS gold, count(*) FILTER (c.hit IS NULL) AS missed FROM gold g LEFT JOIN (SELECT DISTINCT {_K}, 1 AS hit FROM commits) c USING ({_K}) GROUP BY example_id)
SELECT example_id, coalesce(commits, 0) AS commits, coalesce(correct, 0) AS correct, coalesce(commits, 0) - coalesce(correct, 0) AS wrong, coalesce(gold, 0) AS gold, coalesce(missed, 0) AS missed FROM c2 FULL JOIN g2 USING (example_id)"""))
def outcomes(spark, sf_dir):
    s, c = _fixed(spark, sf_dir)
    return M.outcomes(c, s.gold)


@_query("premature", _with(_FIXED, f"SELECT DISTINCT c.example_id, c.start_word, c.end_word, c.label FROM commits c JOIN gold g ON c.example_id = g.example_id AND c.start_word = g.start_word AND c.label = g.label AND c.end_word < g.end_word"))
def premature(spark, sf_dir):
    s, c = _fixed(spark, sf_dir)
    return M.premature(c, s.gold)


_VISIBLE = f""", vis AS (SELECT g.example_id, g.start_word, g.end_word, g.label, g.end_char, min(s.step) AS visible_step, arg_min(s.visible_word_count, s.step) AS visible_words
FROM gold g JOIN steps s ON g.example_id = s.example_id AND s.visible_char_count >= g.end_char GROUP BY ALL)"""


@_query("visibility", _with(_STEPS + _GOLD + _VISIBLE, "SELECT * FROM vis"))
def visibility(spark, sf_dir):
    s = stream(spark, sf_dir)
    return M.visibility(s.gold, s.steps)


@_query("delays", _with(_FIXED + _VISIBLE, f"SELECT c.example_id, c.start_word, c.end_word, c.label, c.step AS commit_step, s.visible_word_count - c.end_word - 1 AS context_words, c.step - v.visible_step AS update_delay FROM commits c JOIN vis v USING ({_K}) JOIN steps s ON s.example_id = c.example_id AND s.step = c.step"))
def delays(spark, sf_dir):
    s, c = _fixed(spark, sf_dir)
    return M.delays(c, M.visibility(s.gold, s.steps), s.steps)


@_query("delay_summary", _with(_FIXED + _VISIBLE, f""", d AS (SELECT c.label, s.visible_word_count - c.end_word - 1 AS w, c.step - v.visible_step AS u FROM commits c JOIN vis v USING ({_K}) JOIN steps s ON s.example_id = c.example_id AND s.step = c.step)
SELECT label, count(*) AS n, avg(w) AS mean_words, quantile_cont(w, 0.5) AS median_words, quantile_cont(w, 0.95) AS p95_words, avg(u) AS mean_updates FROM d GROUP BY label"""))
def delay_summary(spark, sf_dir):
    s, c = _fixed(spark, sf_dir)
    return M.delay_summary(M.delays(c, M.visibility(s.gold, s.steps), s.steps), ["label"])


_OVERLAP = "k.start_word <= x.end_word AND x.start_word <= k.end_word"


def _rounds(ranked: str, group: tuple[str, ...], blocks: str) -> str:
    """SQL of a greedy choice from ``sr`` by rounds: rows that no better undecided row of their group blocks are kept, and what those block goes; the kept rows are ``sf WHERE kept``."""
    same = " AND ".join(f"k.{g} = x.{g}" for g in group)
    met = f"JOIN {{}} k ON {same} AND k.rank {{}} x.rank AND {blocks}"
    key, of = ", ".join([*group, "rank"]), ", ".join(f"x.{g}" for g in (*group, "rank"))
    return f"""sr AS MATERIALIZED ({ranked}),
sf AS (SELECT *, false AS kept FROM sr UNION ALL
(WITH u AS (SELECT * FROM sf WHERE NOT kept), b AS (SELECT DISTINCT {of} FROM u x {met.format("u", "<")}),
f AS (SELECT * FROM u ANTI JOIN b USING ({key})), d AS (SELECT DISTINCT {of} FROM u x {met.format("f", "<=")})
SELECT * EXCLUDE (kept), true FROM f UNION ALL SELECT * EXCLUDE (kept), false FROM u ANTI JOIN d USING ({key})))"""


def _snapshots(blocks: str) -> str:
    """SQL of the decoded states."""
    ranked = "SELECT example_id, step, start_word, end_word, label, probability AS score, row_number() OVER (PARTITION BY example_id, step ORDER BY probability DESC, start_word, end_word, label) AS rank FROM states WHERE probability > 0.9"
    return ", " + _rounds(ranked, ("example_id", "step"), blocks) + ",\nsnap AS (SELECT example_id, step, start_word, end_word, label, score FROM sf WHERE kept)"


#: The commits by rounds: for many rows it needs far less memory than the fold of ``_COMMITS``.
_COMMITS_BY_ROUNDS = f"first AS (SELECT {_K}, min(step) AS step, arg_min(probability, step) AS probability, arg_min(readiness, step) AS readiness FROM ready GROUP BY ALL),\n" + _rounds(
    f"SELECT {_K}, step, readiness, row_number() OVER (PARTITION BY example_id ORDER BY step, readiness DESC, probability DESC, start_word, end_word, label) AS rank FROM first", ("example_id",), _OVERLAP
) + f",\ncommits AS (SELECT {_K}, step, readiness FROM sf WHERE kept)"


_SNAPSHOTS = _snapshots(_OVERLAP)


@_query("snapshots", _with(_OBS + _SNAPSHOTS, "SELECT * FROM snap"))
def snapshots(spark, sf_dir):
    return R.greedy_decode(stream(spark, sf_dir).states, 0.9)


_NESTED = f"""{_OVERLAP}
AND (NOT ((k.start_word <= x.start_word AND x.end_word <= k.end_word) OR (x.start_word <= k.start_word AND k.end_word <= x.end_word)) OR (k.start_word = x.start_word AND k.end_word = x.end_word))"""


@_query("nested_snapshots", _with(_OBS + _snapshots(_NESTED), "SELECT * FROM snap"))
def nested_snapshots(spark, sf_dir):
    return R.greedy_decode(stream(spark, sf_dir).states, 0.9, flat=False)


@_query("boundary_extensions", _with(_OBS + _SNAPSHOTS, """, x AS (SELECT example_id, start_word, end_word, label, step, max(end_word) OVER (PARTITION BY example_id, start_word, label ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM snap)
SELECT * FROM x WHERE end_word > was"""))
def boundary_extensions(spark, sf_dir):
    return V.boundary_extensions(R.greedy_decode(stream(spark, sf_dir).states, 0.9))


@_query("boundary_revisions", _with(_OBS + _SNAPSHOTS, """, x AS (SELECT a.example_id, a.end_word, b.end_word AS was FROM snap a JOIN snap b ON a.example_id = b.example_id AND a.start_word = b.start_word AND a.label = b.label AND b.step = a.step - 1)
SELECT example_id, count(*) AS compared, count(*) FILTER (was <> end_word) AS moved FROM x GROUP BY example_id"""))
def boundary_revisions(spark, sf_dir):
    return V.boundary_revisions(R.greedy_decode(stream(spark, sf_dir).states, 0.9))


@_query("raw_revisions", _with(_UPDATES, """SELECT example_id, count(*) AS updates, count(*) FILTER (update_kind = 'rescore') AS rescores, count(DISTINCT start_word * 100000 + end_word) AS spans,
round(avg(abs(top_probability_delta)), 9) AS mean_change, round(quantile_cont(abs(top_probability_delta), 0.5), 9) AS median_change, round(max(abs(top_probability_delta)), 9) AS max_change FROM updates GROUP BY example_id"""))
def raw_revisions(spark, sf_dir):
    return V.raw_revisions(stream(spark, sf_dir).updates).select("example_id", "updates", "rescores", "spans", *(F.round(c, 9).alias(c) for c in ("mean_change", "median_change", "max_change")))


_DETECTED = f""", det AS (SELECT g.example_id, g.start_word, g.end_word, g.label, min(s.step) AS detection_step FROM (SELECT DISTINCT {_K} FROM gold) g JOIN snap s USING ({_K}) GROUP BY ALL)"""


@_query("first_detections", _with(_OBS + _GOLD + _SNAPSHOTS + _DETECTED, "SELECT * FROM det"))
def first_detections(spark, sf_dir):
    s = stream(spark, sf_dir)
    return V.first_detections(s.gold, R.greedy_decode(s.states, 0.9))


@_query("split_delays", _with(_FIXED + _VISIBLE + _SNAPSHOTS + _DETECTED, f"""SELECT c.example_id, c.start_word, c.end_word, c.label, c.step AS commit_step, s.visible_word_count - c.end_word - 1 AS context_words, c.step - v.visible_step AS update_delay,
d.detection_step - v.visible_step AS model_delay, c.step - d.detection_step AS policy_delay
FROM commits c JOIN vis v USING ({_K}) JOIN steps s ON s.example_id = c.example_id AND s.step = c.step LEFT JOIN det d ON d.example_id = c.example_id AND d.start_word = c.start_word AND d.end_word = c.end_word AND d.label = c.label"""))
def split_delays(spark, sf_dir):
    s, c = _fixed(spark, sf_dir)
    return V.split_delays(M.delays(c, M.visibility(s.gold, s.steps), s.steps), V.first_seen(R.greedy_decode(s.states, 0.9)))


@_query("premature_silver", _with(_FIXED + _SNAPSHOTS, """SELECT DISTINCT c.example_id, c.start_word, c.end_word, c.label FROM commits c JOIN snap g ON c.example_id = g.example_id AND c.start_word = g.start_word AND c.label = g.label AND c.end_word < g.end_word
JOIN (SELECT example_id, max(step) AS step FROM steps GROUP BY 1) l ON l.example_id = g.example_id AND l.step = g.step"""))
def premature_silver(spark, sf_dir):
    s, c = _fixed(spark, sf_dir)
    last = s.obs.where("next_step is null").withColumn("step", F.lit(0).cast("long"))  # what holds after the last step is every candidate's last score
    return M.premature(c, R.greedy_decode(last, 0.9))


@_query("state_differences", _with(_UPDATES, """, a AS (SELECT example_id, start_word, end_word, arg_max(probs, step) AS p FROM updates WHERE step <= 2 GROUP BY ALL), e AS (SELECT example_id, start_word, end_word, arg_max(probs, step) AS p FROM updates WHERE step <= 3 GROUP BY ALL),
d AS (SELECT example_id, start_word, end_word, CASE WHEN a.p IS NULL THEN 'missing' WHEN e.p IS NULL THEN 'unexpected' WHEN abs(a.p[1] - e.p[1]) > 1e-6 OR abs(a.p[2] - e.p[2]) > 1e-6 THEN 'value' END AS difference FROM a FULL JOIN e USING (example_id, start_word, end_word))
SELECT * FROM d WHERE difference IS NOT NULL"""))
def state_differences(spark, sf_dir):
    updates = stream(spark, sf_dir).updates
    return V.state_differences(U.replay(updates, 2), U.replay(updates, 3))


_GRID_COMMITS = _COMMITS + "\nSELECT split_part(example_id, '|', 1) AS policy_id, CAST(split_part(example_id, '|', 2) AS BIGINT) AS example_id, start_word, end_word, label, step, readiness FROM commits"


@_query("commits_threshold_grid", _with(_OBS + """, ready AS (SELECT printf('threshold_%.1f', t) || '|' || example_id AS example_id, start_word, end_word, label, step, probability, probability AS readiness
FROM states JOIN (SELECT unnest([0.5::DOUBLE, 0.6, 0.7, 0.8, 0.9]) AS t) ON probability >= t), """, _GRID_COMMITS))
def commits_threshold_grid(spark, sf_dir):
    """All thresholds of a grid in one pass over the score events."""
    policies = {f"threshold_{t}": F.col("probability") >= t for t in (0.5, 0.6, 0.7, 0.8, 0.9)}
    committed = R.commits(P.first_of_grid(stream(spark, sf_dir).obs, policies), policy=("policy",), first=True)
    name = F.element_at(F.array(*map(F.lit, policies)), F.col("policy") + 1).alias("policy_id")
    return committed.select(name, *(c for c in committed.columns if c != "policy"))


_GATE = _READY["stability_gate"].split("ready AS")[0].rstrip().rstrip(",")


@_query("commits_gate_ablations", _with(_OBS + ", " + _GATE + """, va AS (SELECT *, probability >= 0.6 AS p0, instability <= 0.5 AS p1, label_margin >= 0.1 AS p2, extension_advantage <= 0.3 AS p3, tail_distance_words >= 4 AS p4 FROM gate),
vr AS (SELECT *, 'full' AS v FROM va WHERE p0 AND p1 AND p2 AND p3 UNION ALL SELECT *, 'minus_instability' FROM va WHERE p0 AND p2 AND p3 UNION ALL SELECT *, 'minus_label_margin' FROM va WHERE p0 AND p1 AND p3
UNION ALL SELECT *, 'minus_extension' FROM va WHERE p0 AND p1 AND p2 UNION ALL SELECT *, 'plus_tail_distance' FROM va WHERE p0 AND p1 AND p2 AND p3 AND p4),
ready AS (SELECT v || '|' || example_id AS example_id, start_word, end_word, label, step, probability, probability AS readiness FROM vr), """, _GRID_COMMITS))
def commits_gate_ablations(spark, sf_dir):
    """The stability gate and its ablations in one pass over the score events."""
    s, gates = stream(spark, sf_dir), G.gate_ablations(0.6, 0.5, 0.1, 0.3, 4)
    name = F.split_part("policy_id", F.lit(":"), F.lit(2)).alias("policy_id")  # the variant
    rows = X.commit_rows(s.obs, s.steps, list(gates.values()))
    return rows.select(name, *(c for c in rows.columns if c != "policy_id"))


@_query("churn", _with(_OBS + _SNAPSHOTS, """, b AS (SELECT example_id, step, max(step) OVER (PARTITION BY example_id) AS last FROM steps),
pairs AS (SELECT b.example_id, b.step, s.start_word, s.end_word, s.label, 1 AS here, 0 AS there FROM b JOIN snap s ON s.example_id = b.example_id AND s.step = b.step WHERE b.step > 1
UNION ALL SELECT b.example_id, b.step, s.start_word, s.end_word, s.label, 0, 1 FROM b JOIN snap s ON s.example_id = b.example_id AND s.step = b.step - 1),
x AS (SELECT example_id, step, start_word, end_word, label, max(here) AS h, max(there) AS t FROM pairs GROUP BY ALL)
SELECT b.example_id, CAST(count(*) FILTER (x.h <> x.t) AS BIGINT) AS changed, count(x.h) AS either FROM b LEFT JOIN x ON x.example_id = b.example_id AND x.step = b.step WHERE b.step > 1 GROUP BY b.example_id"""))
def churn(spark, sf_dir):
    s = stream(spark, sf_dir)
    return M.churn(R.greedy_decode(s.states, 0.9), s.steps)


@_query("revision_horizon", _with(_UPDATES, "SELECT example_id, start_word, end_word, arg_max(tail_distance_words, step) AS horizon_words FROM updates WHERE update_kind = 'rescore' GROUP BY ALL"))
def revision_horizon(spark, sf_dir):
    return M.revision_horizons(stream(spark, sf_dir).updates)


@_query("material_horizon", _with(_UPDATES, """, m AS (SELECT *, lag(top_label) OVER (PARTITION BY example_id, start_word, end_word ORDER BY step) AS was FROM updates)
SELECT example_id, start_word, end_word, arg_max(tail_distance_words, step) AS horizon_words FROM m WHERE update_kind = 'rescore' AND (abs(top_probability_delta) >= 0.2 OR was <> top_label) GROUP BY ALL"""))
def material_horizon(spark, sf_dir):
    return M.revision_horizons(stream(spark, sf_dir).updates, 0.2)


@_query("trajectory_stability", _with(_OBS, f""", mv AS (SELECT *, CASE WHEN sign(delta) <> lag(sign(delta)) OVER (PARTITION BY {_K} ORDER BY step) THEN 1 ELSE 0 END AS turned FROM obs WHERE delta <> 0),
tn AS (SELECT {_K}, CAST(sum(turned) AS BIGINT) AS direction_changes FROM mv GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY example_id, start_word, end_word, step ORDER BY probability DESC, label) AS rank FROM obs),
rm AS (SELECT *, CASE WHEN rank <> lag(rank) OVER (PARTITION BY {_K} ORDER BY step) THEN 1 ELSE 0 END AS moved FROM rk)
SELECT {_K}, count(*) AS scores, round(var_pop(probability), 9) AS variance, coalesce(max(abs(delta)), 0.0) AS max_change, round(coalesce(avg(abs(delta)), 0.0), 9) AS mean_change, CAST(sum(moved) AS BIGINT) AS rank_changes,
coalesce(any_value(direction_changes), 0) AS direction_changes FROM rm LEFT JOIN tn USING ({_K}) GROUP BY ALL"""))
def trajectory_stability(spark, sf_dir):
    rows = M.trajectory_stability(stream(spark, sf_dir).obs)
    return rows.withColumns({c: F.round(c, 9) for c in ("variance", "mean_change")})


# --- selection and sampling --------------------------------------------------------------

_POINTS = """WITH pt AS (SELECT l_suppkey AS id, round(avg(l_discount), 6) AS delay, round(avg(l_tax), 6) AS error FROM lineitem GROUP BY 1)"""


def _points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.round(F.avg("l_discount"), 6).alias("delay"), F.round(F.avg("l_tax"), 6).alias("error"))


@_query("pareto_front", _POINTS + " SELECT * FROM pt a WHERE NOT EXISTS (SELECT 1 FROM pt b WHERE b.delay <= a.delay AND b.error <= a.error AND (b.delay < a.delay OR b.error < a.error))")
def pareto_front(spark, sf_dir):
    return S.pareto_2d(_points(spark, sf_dir), "delay", "error")


_CONFIGS = """WITH cf AS (SELECT l_returnflag AS mode, l_linenumber AS id, round(avg(l_discount), 6) AS delay, round(avg(l_tax), 6) AS error, round(avg(l_quantity), 6) AS recall FROM lineitem GROUP BY ALL)"""


def _configs(spark, sf_dir):
    avg = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("id")).agg(avg("l_discount", "delay"), avg("l_tax", "error"), avg("l_quantity", "recall"))


@_query("pareto_three", _CONFIGS + """ SELECT * FROM cf a WHERE NOT EXISTS (SELECT 1 FROM cf b WHERE b.delay <= a.delay AND b.error <= a.error AND b.recall >= a.recall
AND (b.delay < a.delay OR b.error < a.error OR b.recall > a.recall))""")
def pareto_three(spark, sf_dir):
    return S.pareto(_configs(spark, sf_dir), ["delay", "error"], ["recall"])


@_query("constrained_best", _CONFIGS + " SELECT * FROM cf QUALIFY row_number() OVER (PARTITION BY mode ORDER BY CASE WHEN recall >= 25.6 THEN 0 ELSE 1 END, delay, error, id) = 1")
def constrained_best(spark, sf_dir):
    return S.constrained_best(_configs(spark, sf_dir), ["mode"], F.col("recall") >= 25.6, [F.col("delay"), F.col("error"), F.col("id")])


_BOOT_SUMS = _FIXED + _STRICT + """, a1 AS (SELECT example_id, CAST(tp AS DOUBLE) AS a, CAST(tp + fp AS DOUBLE) AS b FROM counts),
lag_ready AS (SELECT * FROM states WHERE probability >= 0.8 AND tail_distance_words >= 4), """ + _COMMITS.replace("first AS", "lfirst AS").replace("arg_min(readiness, step) AS readiness FROM ready", "arg_min(probability, step) AS readiness FROM lag_ready").replace("ranked AS", "lranked AS").replace("FROM first", "FROM lfirst").replace("folded AS", "lfolded AS").replace("FROM ranked", "FROM lranked").replace("un AS", "lun AS").replace("FROM folded", "FROM lfolded").replace("commits AS", "lcommits AS").replace("FROM un)", "FROM lun)") + f""",
lp AS (SELECT DISTINCT {_K}, 1 AS p FROM lcommits), lc AS (SELECT example_id, count(*) FILTER (p IS NOT NULL AND g IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp FROM lp FULL JOIN gr USING ({_K}) GROUP BY example_id),
b1 AS (SELECT example_id, CAST(tp AS DOUBLE) AS c, CAST(tp + fp AS DOUBLE) AS d FROM lc),
su AS (SELECT example_id, example_id % 4 AS task, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d, row_number() OVER (PARTITION BY example_id % 4 ORDER BY example_id) - 1 AS i FROM a1 FULL JOIN b1 USING (example_id)),
sz AS (SELECT task, count(*) AS n FROM su GROUP BY 1),
dr AS (SELECT rep, task, CAST(('0x' || substr(md5('20260901|' || rep || '|' || task || '|' || j), 1, 8)) AS BIGINT) % n AS i FROM (SELECT task, n, unnest(range(n)) AS j FROM sz) CROSS JOIN (SELECT unnest(range(2000)) AS rep)),
rp AS (SELECT rep, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM dr JOIN su USING (task, i) GROUP BY rep),
df AS (SELECT CASE WHEN d <> 0 THEN c / d ELSE 0.0 END - CASE WHEN b <> 0 THEN a / b ELSE 0.0 END AS x FROM rp)
SELECT round(w.a / w.b, 9) AS baseline, round(w.c / w.d, 9) AS comparison, round(w.c / w.d - w.a / w.b, 9) AS difference, round(lower, 9) AS lower, round(upper, 9) AS upper
FROM (SELECT sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM su) w CROSS JOIN (SELECT quantile_cont(x, 0.025) AS lower, quantile_cont(x, 0.975) AS upper FROM df)"""


@_query("bootstrap_difference", _with(_BOOT_SUMS, ""))
def bootstrap_difference(spark, sf_dir):
    """Threshold against lag policy: precision over conversations as parents, tasks as strata."""
    s = stream(spark, sf_dir)
    counts = []
    for policy in ("fixed_threshold", "fixed_lag"):
        c = M.strict_counts(R.commits(_first(s, policy)), s.gold)
        counts.append(c.select("example_id", F.col("tp").cast("double").alias(f"tp_{policy}"), (F.col("tp") + F.col("fp")).cast("double").alias(f"n_{policy}")))
    rows = kept(counts[0].join(counts[1], "example_id", "full").na.fill(0.0).withColumn("task", F.col("example_id") % 4))  # counted, drawn and summed
    out = S.paired_bootstrap(rows, "task", "example_id", ("tp_fixed_threshold", "n_fixed_threshold"), ("tp_fixed_lag", "n_fixed_lag"))
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@_query("bootstrap_mean", """WITH r AS (SELECT l_returnflag AS task, l_suppkey AS parent, CAST(sum(l_discount) AS DOUBLE) AS a, CAST(sum(l_tax) AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL),
su AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY parent) - 1 AS i FROM r), sz AS (SELECT task, count(*) AS k FROM su GROUP BY 1),
dr AS (SELECT rep, task, CAST(('0x' || substr(md5('20260901|' || rep || '|' || task || '|' || j), 1, 8)) AS BIGINT) % k AS i FROM (SELECT task, k, unnest(range(k)) AS j FROM sz) CROSS JOIN (SELECT unnest(range(2000)) AS rep)),
rp AS (SELECT rep, sum(a) / sum(n) AS a, sum(c) / sum(n) AS c FROM dr JOIN su USING (task, i) GROUP BY rep)
SELECT round(w.a, 9) AS baseline, round(w.c, 9) AS comparison, round(w.c - w.a, 9) AS difference, round(lower, 9) AS lower, round(upper, 9) AS upper
FROM (SELECT sum(a) / sum(n) AS a, sum(c) / sum(n) AS c FROM su) w CROSS JOIN (SELECT quantile_cont(c - a, 0.025) AS lower, quantile_cont(c - a, 0.975) AS upper FROM rp)""")
def bootstrap_mean(spark, sf_dir):
    """Mean discount against mean tax of order lines, suppliers as parents, return flags as strata."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("task"), F.col("l_suppkey").alias("parent"), F.col("l_discount").cast("double").alias("a"), F.col("l_tax").cast("double").alias("c"))
    out = S.paired_mean_bootstrap(rows, "task", "parent", "a", "c")
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@_query("parent_split", """SELECT doc_id, CASE WHEN list_reduce(list_transform(string_split(sha256('salt:' || source || ':' || lang || ':' || doc_id), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, c: (a * 16 + c) % 100) < 20 THEN 'dev' ELSE 'test' END AS split FROM documents""")
def parent_split(spark, sf_dir):
    key = F.concat_ws(":", F.lit("salt"), "source", "lang", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", S.split_of(key).alias("split"))


@_query("balanced_sample", """SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('salt:sample:' || source || ':' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 10""")
def balanced_sample(spark, sf_dir):
    key = F.concat_ws(":", F.lit("salt:sample"), "source", F.col("doc_id").cast("string"))
    return S.balanced_sample(table(spark, sf_dir, "documents"), "source", F.sha2(key, 256), "doc_id", 10).select("doc_id", "source", "rank")


@_query("source_diagnostics", """SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (n > 1) AS repeated_texts, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS repeated_rows FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)""")
def source_diagnostics(spark, sf_dir):
    return S.duplicate_diagnostics(table(spark, sf_dir, "documents"), "text")


@_query("task_vocabulary", "SELECT source AS task, array_to_string(list_sort(list_distinct(list(lang))), ',') AS labels FROM documents GROUP BY source")
def task_vocabulary(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("task")).agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("labels"))


@_query("uid_diagnostics", """WITH u AS (SELECT source || lang AS uid, count(*) AS n, count(DISTINCT {'t': n_chars % 2}) AS kinds FROM documents GROUP BY 1)
SELECT count(*) AS uids, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (kinds > 1) AS conflicting, count(*) FILTER (n > 1 AND kinds = 1) AS copies FROM u""")
def uid_diagnostics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat("source", "lang").alias("uid"), (F.col("n_chars") % 2).alias("t"))
    return S.uid_diagnostics(rows, "uid", ["t"])


_CORPUS_SQL = """WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS uid, source, text, length(text) AS n, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE lang END AS language, doc_id % 5 - 1 AS sentence_index, doc_id FROM documents)
SELECT uid, 'blank_language' AS rule FROM c WHERE coalesce(trim(language) = '', true) UNION ALL SELECT uid, 'blank_task_name' FROM c WHERE coalesce(trim(source) = '', true) UNION ALL SELECT uid, 'empty_text' FROM c WHERE coalesce(text = '', true)
UNION ALL SELECT uid, 'sentence_index' FROM c WHERE sentence_index < 0 UNION ALL SELECT uid, 'entity_offsets' FROM c WHERE n - 1 + doc_id % 3 > n OR n - 1 < 0 OR doc_id % 3 = 0"""


@_query("corpus_violations", _CORPUS_SQL)
def corpus_violations(spark, sf_dir):
    """Documents as corpus rows, with faults put in by id."""
    d = table(spark, sf_dir, "documents")
    n = F.length("text").cast("long")
    entity = F.struct((n - 1).alias("start"), (n - 1 + F.col("doc_id") % 3).alias("end"), F.lit("x").alias("label"))
    rows = d.select(F.col("doc_id").cast("string").alias("uid"), F.col("source").alias("task_name"), F.lit("s").alias("source_dataset"), F.lit("u").alias("source_uid"), F.lit("p").alias("parent_id"), (F.col("doc_id") % 5 - 1).alias("sentence_index"), "text", F.array(entity).alias("entities"), F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("lang")).alias("language"))
    return corpus.corpus_violations(rows)

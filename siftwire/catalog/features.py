"""Normalisation, term tables, split, weights, scoring, metrics and explanations.

Where a check is in SQL the terms are built over the lower-cased text: the placeholder patterns
look around themselves, which DuckDB's patterns cannot.  The operators are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import explain as x
from ..operators import features as f
from ..operators import metrics as mt
from ..operators import model as md
from ..operators import normal as nm
from ..operators import split as sp
from ..operators.grams import Terms
from ..plans import jobs
from ..plans.messages import read_table
from ..sources import sinks
from . import sql as q
from .base import add, docs, msgs, work_dir

_W, _S = r"[\p{L}\p{N}_]", r"[\s\x{85}\p{Z}]"


def _undo_sql(col: str) -> str:
    e = f"regexp_replace({col}, '({_W}){_S}+''{_S}+({_W})', '\\1''\\2', 'g')"
    e = f"regexp_replace({e}, '{_S}+([.,!?;:%)])', '\\1', 'g')"
    e = f"regexp_replace({e}, '(\\p{{Nd}}){_S}*([.,]){_S}*(\\p{{Nd}})', '\\1\\2\\3', 'g')"
    return f"regexp_replace({e}, '([$£€₹]){_S}+(\\p{{Nd}})', '\\1\\2', 'g')"


_JOINED = f"jn AS (SELECT doc_id, source, lang, {_undo_sql('text')} AS joined FROM documents)"
_CAPS = f"len(list_filter(regexp_extract_all(joined, '{_W}+'), lambda x: regexp_full_match(x, '[A-Z]{{3,}}')))"

add("c1_undo_pretokenised", lambda s, d: docs(s, d).select(
    "doc_id", t.undo_pretokenised(F.col("text")).alias("joined")),
    f"WITH {_JOINED} SELECT doc_id, joined FROM jn")
add("c2_caps_words", lambda s, d: docs(s, d).select("doc_id", t.caps_count(t.undo_pretokenised(
    F.col("text"))).cast("bigint").alias("caps")),
    f"WITH {_JOINED} SELECT doc_id, {_CAPS} AS caps FROM jn")
add("c3_placeholders", lambda s, d: docs(s, d).select("doc_id", t.substitute_placeholders(
    t.undo_pretokenised(F.col("text"))).alias("marked")))
add("c4_squeeze_lower", lambda s, d: docs(s, d).select("doc_id", F.concat(
    t.squeeze_lower(F.col("text")), F.when(t.caps_count(F.col("text")) >= 2, " zzcaps").otherwise("")).alias("body")),
    f"""SELECT doc_id, lower(regexp_replace(regexp_replace(joined, '{_S}+', ' ', 'g'), '^ | $', '', 'g')) ||
  CASE WHEN {_CAPS} >= 2 THEN ' zzcaps' ELSE '' END AS body FROM (SELECT doc_id, text AS joined FROM documents)""")
add("c5_normalise", lambda s, d: nm.with_normalised(docs(s, d)).select("doc_id", "norm", "norm_short"))
add("c6_placeholder_profile", lambda s, d: nm.placeholder_profile(nm.with_normalised(docs(s, d)), ["source", "lang"]))

# --- term tables over the lower-cased text ----------------------------------------------------------
#: Shown by one query as the parameter it is.
CAPPED = {"word": 5000, "char": 8000}
_W_EXPR = "((df * 7 + total * 3 + length(gram) * 5) % 21 - 10) / 50.0D"
_BIAS = -0.25


def light(df: DataFrame) -> DataFrame:
    return df.withColumn("norm", F.lower("text")).withColumn("norm_short", F.col("norm"))


def doc_terms(s: SparkSession, d: str, bias: bool = False) -> Terms:
    return f.term_table(light(read_table(s, d, "documents")), "doc_id", chars="norm", with_bias=bias)


def msg_terms(s: SparkSession, d: str, bias: bool = False) -> Terms:
    return f.term_table(light(msgs(s, d)), "msg_id", chars="norm", with_bias=bias)


def derived_model(vocab: DataFrame) -> md.Model:
    """Weights that are a fixed function of the counts, so that both engines know them.

    The model comes from a written table, as in production: its rows are counted, and its making is
    not planned again by each user.
    """
    path = work_dir(vocab.sparkSession, "model")
    md.model_of(vocab.withColumn("w", F.expr(_W_EXPR)), _BIAS, 0).save(path)
    return md.Model.load(vocab.sparkSession, path)


def terms_sql(source: str, key: str) -> str:
    """CTEs lt, wg, tt: light text, windows of words, term table."""
    return f"""
lt AS (SELECT {key} AS id, lower(text) AS norm FROM {source}),
tk AS (SELECT id, regexp_extract_all(norm, '{_W}+') AS toks FROM lt),
wd AS (SELECT id, ' ' || w || ' ' AS pad FROM (SELECT id, unnest(regexp_extract_all(norm, '[^\\s\\x{{85}}\\p{{Z}}]+')) AS w FROM lt)),
cg AS (SELECT id, substr(pad, i, n) AS gram FROM (
  SELECT id, pad, n, unnest(range(1, greatest(length(pad) - n + 1, 1) + 1)) AS i FROM (
    SELECT id, pad, unnest([3, 4, 5]) AS n FROM wd) WHERE n = 3 OR n <= length(pad))),
wg AS (SELECT id, unnest(toks) AS gram FROM tk UNION ALL
  SELECT id, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) FROM tk),
tt AS (SELECT id, 'word' AS kind, gram, count(*) AS tf FROM wg GROUP BY ALL
  UNION ALL SELECT id, 'char', gram, count(*) FROM cg GROUP BY ALL)"""


_VOCAB = f"""
vo AS (SELECT kind, gram, df, total, ln((1.0 + (SELECT count(*) FROM lt)) / (1.0 + df)) + 1.0 AS idf,
    ((df * 7 + total * 3 + length(gram) * 5) % 21 - 10) / 50.0 AS w
  FROM (SELECT kind, gram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tt GROUP BY ALL)
  WHERE df >= CASE kind WHEN 'word' THEN 2 ELSE 3 END)"""
_XS = """
xr AS (SELECT t.id, t.kind, t.gram, t.tf, v.w, (ln(t.tf) + 1.0) * v.idf AS r FROM tt t JOIN vo v USING (kind, gram)),
xs AS (SELECT *, r / sqrt(sum(r * r) OVER (PARTITION BY id, kind)) AS x FROM xr)"""
_DOC_T = f"WITH {terms_sql('documents', 'doc_id')}"
_DOC_V = f"{_DOC_T}, {_VOCAB}, {_XS}"
_MSG_V = f"WITH {q.M}, {terms_sql('m', 'msg_id')}, {_VOCAB}, {_XS}"


def doc_vocab(s, d):
    return f.with_idf(f.vocabulary(doc_terms(s, d)), read_table(s, d, "documents"))


def msg_vocab(s, d):
    return f.with_idf(f.vocabulary(msg_terms(s, d)), read_table(s, d, "events"))


add("d1_word_tokens", lambda s, d: light(docs(s, d)).select("doc_id", F.array_join(t.word_tokens(F.col("norm")), " ").alias("tokens")),
    f"{_DOC_T} SELECT id AS doc_id, array_to_string(toks, ' ') AS tokens FROM tk")
add("d2_word_grams", lambda s, d: light(docs(s, d)).select("doc_id", F.array_join(
    t.word_grams(t.word_tokens(F.col("norm"))), "|").alias("grams")), f"""{_DOC_T}
SELECT id AS doc_id, array_to_string(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])), '|')
  AS grams FROM tk""")
add("d3_char_grams", lambda s, d: light(docs(s, d)).select("doc_id", t.char_grams(F.col("norm_short")).alias("g")).select(
    "doc_id", F.size("g").cast("bigint").alias("grams"), F.size(F.array_distinct("g")).cast("bigint").alias("different"),
    F.array_min("g").alias("low"), F.array_max("g").alias("high")), f"""{_DOC_T}
SELECT id AS doc_id, count(*) AS grams, count(DISTINCT gram) AS different, min(gram) AS low, max(gram) AS high FROM cg GROUP BY id""")
add("d4_term_frequency", lambda s, d: doc_terms(s, d).rows().groupBy("doc_id", "kind").agg(
    F.count("*").alias("grams"), F.sum("tf").alias("total"), F.max("tf").alias("top"),
    F.sum(F.col("tf") * F.col("tf") * F.length("gram")).alias("mix")), f"""{_DOC_T}
SELECT id AS doc_id, kind, count(*) AS grams, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS top,
  CAST(sum(tf * tf * length(gram)) AS BIGINT) AS mix FROM tt GROUP BY ALL""")
add("d5_vocabulary", lambda s, d: f.vocabulary(doc_terms(s, d)).select("kind", "gram", "df", "total"),
    f"{_DOC_V} SELECT kind, gram, df, total FROM vo")
add("d5_vocabulary_capped", lambda s, d: f.vocabulary(doc_terms(s, d), max_terms=CAPPED).select("kind", "gram", "df", "total"),
    f"""{_DOC_V} SELECT kind, gram, df, total FROM vo QUALIFY row_number() OVER (PARTITION BY kind ORDER BY total DESC, gram)
  <= CASE kind WHEN 'word' THEN {CAPPED['word']} ELSE {CAPPED['char']} END""")
add("d6_idf", lambda s, d: doc_vocab(s, d).select("kind", "gram", F.round("idf", 6).alias("idf")),
    f"{_DOC_V} SELECT kind, gram, round(idf, 6) AS idf FROM vo")
add("d7_damped_tf", lambda s, d: doc_terms(s, d).rows().groupBy("doc_id", "kind").agg(
    F.round(F.sum(f.damped(F.col("tf"))), 6).alias("damped")),
    f"{_DOC_T} SELECT id AS doc_id, kind, round(sum(1.0 + ln(tf)), 6) AS damped FROM tt GROUP BY ALL")
add("d8_unit_terms", lambda s, d: f.weighted_terms(doc_terms(s, d), doc_vocab(s, d), grams=False).groupBy("doc_id", "kind").agg(
    F.count("*").alias("grams"), F.round(F.sum("x"), 6).alias("sum_x"), F.round(F.max("x"), 6).alias("max_x"),
    F.round(F.sum(F.col("x") * F.col("x")), 6).alias("norm")), f"""{_DOC_V}
SELECT id AS doc_id, kind, count(*) AS grams, round(sum(x), 6) AS sum_x, round(max(x), 6) AS max_x, round(sum(x * x), 6) AS norm
FROM xs GROUP BY ALL""")
add("d9_feature_index", lambda s, d: f.indexed_vocabulary(f.vocabulary(doc_terms(s, d)).select("kind", "gram"),
    work_dir(s, "d9")),
    f"{_DOC_V} SELECT kind, gram, row_number() OVER (ORDER BY kind DESC, gram) - 1 AS idx FROM vo")

# --- split, weights, scoring, metrics ----------------------------------------------------------------------


def labelled(s, d):
    return docs(s, d).join(read_table(s, d, "labels"), "doc_id").select(
        "doc_id", "text", "source", F.col("toxic").alias("label"))


_LAB = "lb AS (SELECT d.doc_id, d.source, l.toxic AS label FROM documents d JOIN labels l USING (doc_id))"
_SPLIT = f"""{_LAB},
ce AS (SELECT source, label, count(*) AS n FROM lb GROUP BY ALL),
tn AS (SELECT *, (total * 20 + 99) // 100 AS test FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS total FROM ce)),
bs AS (SELECT *, (test * n) // total AS base, (test * n) % total AS rest FROM tn),
qt AS (SELECT source, label, base + CASE WHEN row_number() OVER (PARTITION BY source ORDER BY rest DESC, label)
   <= test - sum(base) OVER (PARTITION BY source) THEN 1 ELSE 0 END AS quota FROM bs)"""
add("e1_stratified_split", lambda s, d: sp.with_split(labelled(s, d).drop("text"), "doc_id").select("doc_id", "source", "label", "split"),
    f"""WITH {_SPLIT} SELECT doc_id, source, label, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM (
  SELECT lb.*, quota, row_number() OVER (PARTITION BY lb.source, lb.label ORDER BY md5('42:' || doc_id), doc_id) AS rn
  FROM lb JOIN qt ON lb.source = qt.source AND lb.label = qt.label)""")
add("e2_cell_weights", lambda s, d: sp.with_weights(labelled(s, d).drop("text")).select(
    "doc_id", "source", "label", F.round("weight", 6).alias("weight")), f"""WITH {_LAB},
ce AS (SELECT source, label, count(*) AS n FROM lb GROUP BY ALL)
SELECT doc_id, source, label, round((1 / sqrt(n)) * (SELECT sum(n) / sum(sqrt(n)) FROM ce), 6) AS weight
FROM lb JOIN ce USING (source, label)""")


def _fit(s, d, **limits):
    rows = labelled(s, d).withColumnRenamed("doc_id", "msg_id")
    return mt.by_source(jobs.train(rows, work_dir(s, "e3"), **limits)[1])


add("e3_fit_and_evaluate", _fit)
#: The same job with every coefficient in a table.
add("e3_fit_by_tables", lambda s, d: _fit(s, d, dense_terms=0))


def doc_scores(s, d):
    return md.score(doc_terms(s, d, bias=True), derived_model(doc_vocab(s, d)))


_SC = f"""{_DOC_V},
sc AS (SELECT lt.id AS doc_id, 1 / (1 + exp(-({_BIAS} + coalesce(sum(x * w), 0)))) AS p FROM lt LEFT JOIN xs ON lt.id = xs.id GROUP BY lt.id)"""
_PRED = f"{_SC}, pr AS (SELECT lb.*, CAST(sc.p >= 0.5 AS INTEGER) AS pred FROM lb JOIN sc USING (doc_id))".replace(
    "WITH ", f"WITH {_LAB},", 1)
add("e4_score", lambda s, d: doc_scores(s, d).select("doc_id", F.round("p", 6).alias("p")),
    f"{_SC} SELECT doc_id, round(p, 6) AS p FROM sc")


def predicted(s, d):
    p = doc_scores(s, d).select("doc_id", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("pred"))
    return labelled(s, d).drop("text").join(p, "doc_id")


add("e5_threshold", lambda s, d: predicted(s, d).select("doc_id", "pred"), f"{_PRED} SELECT doc_id, pred FROM pr")
_RATES = """round((tp + tn) / n, 4) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS "precision",
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1, n, tn, fp, fn, tp"""
_CONF = """count(*) AS n, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp"""
GROUPS = {"low": ("src0", "src1", "src2", "src3"), "even": ("src0", "src2", "src4")}
add("e6_source_metrics", lambda s, d: mt.by_source(predicted(s, d)),
    f"{_PRED} SELECT source, {_RATES} FROM (SELECT source, {_CONF} FROM pr GROUP BY source)")
add("e7_group_metrics", lambda s, d: mt.by_group(predicted(s, d), mt.membership(s, GROUPS)), f"""{_PRED},
gp AS (SELECT 'all' AS grp, * FROM pr {" ".join(f"UNION ALL SELECT '{g}', * FROM pr WHERE source IN {q.names(v)}" for g, v in GROUPS.items())})
SELECT grp, {_RATES} FROM (SELECT grp, {_CONF} FROM gp GROUP BY grp)""")


def _metrics_sink(s, d):
    path = work_dir(s, "a10")
    sinks.write_metrics({"per_source": mt.by_source(predicted(s, d))}, path)
    kept = s.read.schema("source string, n bigint, tn bigint, fp bigint, fn bigint, tp bigint, f1 double").json(f"{path}/per_source")
    return kept


add("a10_metrics_sink", _metrics_sink,
    f"{_PRED} SELECT source, n, tn, fp, fn, tp, f1 FROM (SELECT source, {_RATES} FROM (SELECT source, {_CONF} FROM pr GROUP BY source))")


def _model_sink(s, d):
    path = work_dir(s, "a9")
    derived_model(doc_vocab(s, d)).save(path)
    return md.Model.load(s, path).weights.select("kind", "gram", F.round("w", 6).alias("w"))


add("a9_model_sink", _model_sink, f"{_DOC_V} SELECT kind, gram, round(w, 6) AS w FROM vo UNION ALL SELECT 'bias', '', {_BIAS}")
_TOP = """(SELECT '{s}' AS side, kind, gram, w FROM vo ORDER BY w {o}, kind, gram LIMIT 20)"""
add("e8_top_weights", lambda s, d: md.top_weights(derived_model(doc_vocab(s, d))).select(
    "side", "kind", "gram", F.round("w", 6).alias("w")),
    f"{_DOC_V} SELECT side, kind, gram, round(w, 6) AS w FROM ({_TOP.format(s='spam', o='DESC')} UNION ALL {_TOP.format(s='ham', o='ASC')})")

# --- explanations over the message table ---------------------------------------------------------------------


def msg_features(s, d, top=None, first_of_word=False):
    return x.feature_table(light(msgs(s, d)), derived_model(msg_vocab(s, d)), chars="norm", top=top, first_of_word=first_of_word)


def msg_pointing(s, d):
    return x.Pointing(light(msgs(s, d)), derived_model(msg_vocab(s, d)), chars="norm")


_ATT = f"""{_MSG_V},
wl AS (SELECT id, regexp_extract_all(norm, '[^\\s\\x{{85}}\\p{{Z}}]+') AS ws FROM lt),
ws AS (SELECT id, pos - 1 AS pos, ws[pos] AS word, ws[pos + 1] AS after, len(ws) AS n FROM (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM wl)),
wt AS (SELECT *, regexp_extract_all(word, '{_W}+') AS own, regexp_extract_all(coalesce(after, ''), '{_W}+') AS nxt FROM ws),
ft AS (SELECT id, kind, gram, x, x * w AS c, split_part(gram, ' ', 1) AS t0, split_part(gram, ' ', 2) AS t1, trim(gram) AS core FROM xs),
ht AS (
  SELECT DISTINCT f.id, f.kind, f.gram, f.c, w.pos, w.word FROM ft f JOIN wt w ON f.id = w.id WHERE f.kind = 'char' AND
    CASE WHEN f.gram LIKE ' % ' THEN w.word = f.core WHEN f.gram LIKE ' %' THEN starts_with(w.word, f.core)
         WHEN f.gram LIKE '% ' THEN ends_with(w.word, f.core) ELSE contains(w.word, f.core) END
  UNION SELECT f.id, f.kind, f.gram, f.c, w.pos, w.word FROM ft f JOIN wt w ON f.id = w.id
    WHERE f.kind = 'word' AND f.t1 = '' AND list_contains(w.own, f.t0)
  UNION SELECT f.id, f.kind, f.gram, f.c, p.pos, p.word FROM ft f JOIN wt w ON f.id = w.id JOIN wt p ON p.id = w.id
      AND (p.pos = w.pos OR (p.pos = w.pos + 1 AND NOT list_contains(w.own, f.t1)))
    WHERE f.kind = 'word' AND f.t1 <> '' AND list_contains(w.own, f.t0) AND w.pos + 1 < w.n
      AND (list_contains(w.nxt, f.t1) OR list_contains(w.own[list_position(w.own, f.t0) + 1:], f.t1))),
sh AS (SELECT *, c / count(*) OVER (PARTITION BY id, kind, gram) AS share FROM ht)"""
add("f1_contributions", lambda s, d: md.contributions(msg_terms(s, d), derived_model(msg_vocab(s, d))).groupBy("msg_id", "kind").agg(
    F.count("*").alias("grams"), F.round(F.sum("c"), 6).alias("c"), F.round(F.max("c"), 6).alias("top")),
    f"{_MSG_V} SELECT id AS msg_id, kind, count(*) AS grams, round(sum(x * w), 6) AS c, round(max(x * w), 6) AS top FROM xs GROUP BY ALL")
_TOPK = f"""{_MSG_V},
rc AS (SELECT id, kind, gram, round(x * w, 4) AS c, CASE kind WHEN 'word' THEN 0 ELSE 1 END AS b FROM xs),
tp AS (SELECT id, 'spam' AS side, kind, gram, c, row_number() OVER (PARTITION BY id ORDER BY c DESC, b DESC, gram DESC) AS rk FROM rc WHERE c > 0
  UNION ALL SELECT id, 'ham', kind, gram, c, row_number() OVER (PARTITION BY id ORDER BY c, b, gram) FROM rc WHERE c < 0)"""


def top(s, d):
    return x.top_features(md.contributions(msg_terms(s, d), derived_model(msg_vocab(s, d)), top=x.TOP_K))


add("f2_top_features", lambda s, d: top(s, d).select("msg_id", "side", "rank", "contribution"),
    f"{_TOPK} SELECT id AS msg_id, side, rk AS rank, c AS contribution FROM tp WHERE rk <= 8")
add("f3_feature_labels", lambda s, d: top(s, d).select("msg_id", "side", "rank", "feature", "type"), f"""{_TOPK}
SELECT id AS msg_id, side, rk AS rank, CASE kind WHEN 'char' THEN replace(gram, ' ', '␣') ELSE gram END AS feature,
  CASE WHEN kind = 'word' AND contains(gram, ' ') THEN 'phrase' ELSE kind END AS type FROM tp WHERE rk <= 8""")
add("f4_attribution", lambda s, d: msg_features(s, d).groupBy("msg_id", "kind").agg(
    F.sum(F.size("hits")).alias("hits"), F.count_if(F.size("hits") > 0).alias("placed")),
    f"""{_ATT} SELECT xs.id AS msg_id, xs.kind, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS hits, count(h.n) AS placed FROM xs
  LEFT JOIN (SELECT id, kind, gram, count(*) AS n FROM ht GROUP BY ALL) h USING (id, kind, gram) GROUP BY ALL""")
add("f5_word_scores", lambda s, d: x.word_scores(msg_pointing(s, d)).select("msg_id", "pos", F.round("score", 6).alias("score")),
    f"{_ATT} SELECT id AS msg_id, pos, round(sum(share), 6) AS score FROM sh GROUP BY ALL")


def _words(s, d):
    words = light(msgs(s, d)).select("msg_id", t.split_words(F.col("norm")).alias("_w"))
    best = x.top_features(msg_features(s, d, x.TOP_K, first_of_word=True)).join(words, "msg_id")
    return best.select("msg_id", "side", "rank", F.array_join(x.source_words(F.col("hits"), F.col("_w")), ",").alias("words"))


add("f6_source_words", _words, _ATT + _TOPK.replace(_MSG_V, "") + """
SELECT tp.id AS msg_id, side, rk AS rank, coalesce(array_to_string(list_sort(h.ws)[1:3], ','), '') AS words FROM tp
LEFT JOIN (SELECT id, kind, gram, list(DISTINCT word) AS ws FROM ht GROUP BY ALL) h USING (id, kind, gram) WHERE rk <= 8""")


def _spans(s, d):
    rows = msgs(s, d)
    normal = light(rows)
    means = x.word_means(normal, x.word_scores(msg_pointing(s, d), rows=False))
    return x.highlights(rows, means)


add("f7_highlights", _spans)
add("j4_analyse", lambda s, d: jobs.analyse(msgs(s, d), derived_model(f.with_idf(
    f.vocabulary(f.message_terms(msgs(s, d))), read_table(s, d, "events"))), work_dir=work_dir(s, "j4")).select(
    "msg_id", "label", "verdict", "spam_probability", F.size("red_flags").alias("n_flags"),
    F.size("top_spam_features").alias("n_up"), F.size("highlights").alias("n_spans"), "bias"))

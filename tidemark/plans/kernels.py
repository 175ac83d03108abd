"""Queries: text kernels, statistics, samples, twins, topics, queue, quota, retention, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A, evaluation as E, lifecycle as L, sampling as S, topics as TP
from ..sources import files, paged
from ..sources.store import shared_folder, through_csv
from .bindings import TEXTS_SQL
from .registrar import query

TX = "WITH " + TEXTS_SQL
CLASSES = ("negative", "neutral", "positive")


# Text ---------------------------------------------------------------------------------------------------------
@query("str_canonical_text", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.md5(T.canonical(F.col("text")).cast("binary")).alias("digest"))


@query("str_typography", "SELECT doc_id, md5(replace(replace(text, '…', '...'), '´', '''')) AS digest FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.md5(T.typography(F.col("text")).cast("binary")).alias("digest"))


@query("str_model_text", "SELECT doc_id, md5(trim(regexp_replace(replace(replace(text, '…', '...'), '´', ''''), '\\s+', ' ', 'g'))) AS digest FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.md5(T.model_text(F.col("text")).cast("binary")).alias("digest"))


@query("str_emoji_to_words")
def _(v):
    sign = F.element_at(F.array(*map(F.lit, ("👍🏽", "❤️", "🇧🇷", "🐈", "⭐"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return v.table("documents").select("doc_id", F.md5(T.model_text(F.concat("text", sign)).cast("binary")).alias("digest"))


@query("str_topic_clean", "SELECT doc_id, md5(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(?:https?://|www\\.)\\S+', ' ', 'g'), '@[\\w.\\-]+', ' ', 'g'), '\\b\\d{1,2}(?::\\d{2}){1,2}\\b', ' ', 'g'), '[\\p{So}\\p{Sk}\\p{Cf}]', ' ', 'g'))) AS digest FROM documents")
def _(v):
    return v.documents.select("doc_id", F.md5(T.topic_clean(F.col("text")).cast("binary")).alias("digest"))


@query("str_symbol_class", "SELECT doc_id, length(regexp_replace(text, '[\\p{So}\\p{Sk}\\p{Cf}]', ' ', 'g'))::INT AS n FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.length(F.regexp_replace("text", r"[\p{So}\p{Sk}\p{Cf}]", " ")).alias("n"))


WORDS_SQL = "regexp_extract_all({}, '[\\p{{L}}\\p{{No}}\\p{{Nl}}]+(?:-[\\p{{L}}\\p{{No}}\\p{{Nl}}]+)*')"
STOP = ["and", "the", "der", "die", "les", "que", "para", "las"]
TOKENS_SQL = f"{TX}, tokens AS (SELECT execution_id, comment_id, video, unnest(list_filter(list_transform(list_filter({WORDS_SQL.format('lower(text)')}, lambda w: length(w) >= 3 AND NOT regexp_matches(w, '(?i)^(?:k{{2,}}|(?:ha){{2,}}|(?:rs){{2,}}|h[aeiu]{{2,}}|s{{2,}})$')), lambda w: strip_accents(w)), lambda w: NOT list_contains({STOP}, w))) AS token FROM texts)"


def tokens(v, texts=None):
    """A row a token. Words are exploded first, so that what follows is compiled code over plain strings."""
    words = (v.texts if texts is None else texts).select("execution_id", "comment_id", "video", F.explode(T.words(F.lower("text"))).alias("word"))
    return T.only_tokens(words, "word", STOP)


@query("str_topic_tokens", f"{TOKENS_SQL} SELECT execution_id, token, count(*)::BIGINT AS n FROM tokens GROUP BY ALL")
def _(v):
    words = v.texts.select("execution_id", F.explode(T.words(F.lower("text"))).alias("word")).groupBy("execution_id", "word").agg(F.count("*").alias("n"))
    return T.only_tokens(words, "word", STOP).groupBy("execution_id", "token").agg(F.sum("n").alias("n"))


@query("str_topic_prepare", f"{TOKENS_SQL} SELECT comment_id, count(*)::BIGINT AS n FROM tokens GROUP BY ALL")
def _(v):
    return tokens(v).groupBy("comment_id").agg(F.count("*").alias("n"))


@query("str_lexicon_tokens", f"SELECT doc_id, len({WORDS_SQL.format('text')})::INT AS n FROM documents")
def _(v):
    return v.documents.select("doc_id", F.size(T.words(F.col("text"))).alias("n"))


@query("str_laughter", "SELECT w, regexp_matches(w, '(?i)^(?:k{2,}|(?:ha){2,}|(?:rs){2,}|h[aeiu]{2,}|s{2,})$') AS laughs FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,6}')) AS w FROM documents)")
def _(v):
    w = v.table("documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,6}"), F.lit(0)))).alias("w")).distinct()
    return w.select("w", F.col("w").rlike(T.LAUGHTER).alias("laughs"))


@query("str_keyword_key", "SELECT DISTINCT strip_accents(lower(trim(w))) AS key FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE regexp_matches(w, '^[A-Za-zÀ-ÿ]+$') AND NOT contains(w, 'ß')")
def _(v):
    w = v.table("documents").select(F.explode(F.array_distinct(F.split("text", " "))).alias("w")).where(F.col("w").rlike("^[A-Za-zÀ-ÿ]+$") & ~F.col("w").contains("ß"))
    return w.select(T.fold(F.lower(F.trim("w"))).alias("key")).distinct()


@query("str_hash", "SELECT doc_id, sha256(source) AS hash FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.sha2("source", 256).alias("hash"))


@query("str_author_hash", "SELECT doc_id, sha256(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), lang)) AS hash FROM documents")
def _(v):
    a = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    return v.table("documents").select("doc_id", F.sha2(F.coalesce(F.nullif(a, F.lit("")), F.col("lang")), 256).alias("hash"))


@query("str_video_id", "SELECT page_id, regexp_extract(u, 'v=([A-Za-z0-9_-]{11})', 1) AS id FROM (SELECT page_id, 'https://example.org/watch?v=' || substr(md5(url), 1, 11) AS u FROM pages)")
def _(v):
    u = F.concat(F.lit("https://example.org/watch?v="), F.substring(F.md5(F.col("url").cast("binary")), 1, 11))
    return v.table("pages").select("page_id", T.video_id(u).alias("id"))


KAPPA = "CASE WHEN k < 0 THEN 'pobre' WHEN k < 0.2 THEN 'leve' WHEN k < 0.4 THEN 'razoavel' WHEN k < 0.6 THEN 'moderada' WHEN k < 0.8 THEN 'substancial' ELSE 'quase perfeita' END"


@query("str_landis_koch", f"SELECT doc_id, {KAPPA} AS band FROM (SELECT doc_id, (doc_id % 120)::DOUBLE / 100 - 0.1 AS k FROM documents)")
def _(v):
    return v.table("documents").select("doc_id", T.landis_koch((F.col("doc_id") % 120).cast("double") / 100 - F.lit(0.1)).alias("band"))


@query("flt_like_escaped", "SELECT doc_id FROM documents WHERE contains(lower(text), '%')")
def _(v):
    pattern = T.escape_like(F.lit("%"))
    d = v.table("documents").withColumn("_p", pattern)
    return d.where(F.expr(r"text ILIKE _p ESCAPE '\\'")).select("doc_id")


@query("flt_contains_term", "SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'cion')")
def _(v):
    return v.table("documents").where(T.fold(F.lower("text")).contains("cion")).select("doc_id")


#: All texts are Latin, so two of three get some or most of their letters in another script.
CYRILLIC = {1: ("eio", "еіо"), 2: ("aeinorst", "аеинорст")}
SCRIPTS_SQL = f"SELECT doc_id, CASE doc_id % 3 {' '.join(f'WHEN {k} THEN translate(text, {a!r}, {b!r})' for k, (a, b) in CYRILLIC.items())} ELSE text END AS text FROM documents"


@query("flt_nonlatin_strict", f"SELECT doc_id FROM ({SCRIPTS_SQL}) WHERE length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) >= 3 AND 2 * length(regexp_replace(text, '[^\\p{{Latin}}]', '', 'g')) < length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))")
def _(v):
    third = F.col("doc_id") % 3
    text = F.when(third == 1, F.translate("text", *CYRILLIC[1])).when(third == 2, F.translate("text", *CYRILLIC[2])).otherwise(F.col("text"))
    return v.table("documents").select("doc_id", text.alias("text")).where(T.nonlatin_strict(F.col("text"))).select("doc_id")


@query("flt_nonlatin_export", "SELECT count(*)::BIGINT AS n FROM documents WHERE length(regexp_replace(text, '[^\\p{L}]', '', 'g')) = 0 OR length(regexp_replace(text, '[^\\p{Latin}]', '', 'g')) >= 0.5 * length(regexp_replace(text, '[^\\p{L}]', '', 'g'))")
def _(v):
    return v.table("documents").where(T.latin_share_ok(F.col("text"))).agg(F.count("*").alias("n"))


@query("flt_text_present", "SELECT doc_id FROM documents WHERE text IS NOT NULL")
def _(v):
    return v.table("documents").where("text is not null").select("doc_id")


@query("flt_language", "SELECT doc_id FROM documents WHERE lang = 'es' OR len(regexp_extract_all(text, '\\p{L}{2,}')) < 3")
def _(v):
    few = F.size(F.regexp_extract_all("text", F.lit(r"\p{L}{2,}"), F.lit(0))) < 3
    return v.table("documents").where((F.col("lang") == "es") | few).select("doc_id")


LEX = {"the": 1, "and": -1, "que": 1, "der": -1, "les": 1, "with": -1}
LEX_SQL = " + ".join(f"{p} * len(list_filter(w, lambda x: x = '{k}'))" for k, p in LEX.items())


@query("udf_lexicon_score", f"SELECT doc_id, ({LEX_SQL})::INT AS score, CASE WHEN {LEX_SQL} > 0 THEN 'positive' WHEN {LEX_SQL} < 0 THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT doc_id, {WORDS_SQL.format('lower(text)')} AS w FROM documents)")
def _(v):
    lexicon = F.create_map(*[F.lit(x) for kv in LEX.items() for x in kv])
    s = v.documents.select("doc_id", T.lexicon_score(T.words(F.lower("text")), lexicon).alias("s"))
    return s.select("doc_id", "s.score", "s.label")


@query("str_justification")
def _(v):
    lexicon = F.create_map(*[F.lit(x) for kv in LEX.items() for x in kv])
    s = v.documents.select("doc_id", T.lexicon_score(T.words(F.lower("text")), lexicon).alias("s"))
    return s.select("doc_id", T.justification(F.col("s.terms")).alias("why"))


@query("str_confidence", "SELECT doc_id, 'confiança do modelo: a ' || (50 + doc_id % 40) || '% · b ' || (50 - doc_id % 40) || '%' AS shown FROM documents WHERE doc_id % 40 > 0")
def _(v):
    k = F.col("doc_id") % 40
    m = F.create_map(F.lit("b"), (50 - k) / 100, F.lit("a"), (50 + k) / 100)
    return v.table("documents").where(k > 0).select("doc_id", T.confidence(m).alias("shown"))


# Lexicon, brand words, topics ---------------------------------------------------------------------------------
ENTRIES = "SELECT lower(w) AS key, (CASE WHEN doc_id % 5 = 0 THEN -1 ELSE 1 END)::INT AS polarity FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS w FROM documents)"


@query("agg_lexicon_index", f"SELECT key, min(polarity)::INT AS polarity FROM ({ENTRIES}) GROUP BY key HAVING min(polarity) = max(polarity)")
def _(v):
    w = v.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0))).alias("w"))
    return A.lexicon_index(w.select(F.lower("w").alias("key"), F.when(F.col("doc_id") % 5 == 0, -1).otherwise(1).alias("polarity")), "key", "polarity")


@query("agg_spelling_mode", "SELECT key, form, occurrences::BIGINT AS occurrences FROM (SELECT key, form, sum(n) OVER (PARTITION BY key) AS occurrences, row_number() OVER (PARTITION BY key ORDER BY n DESC, form) AS r FROM (SELECT lower(w) AS key, w AS form, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS w FROM documents) GROUP BY ALL)) WHERE r = 1")
def _(v):
    w = v.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("form"))
    return A.spelling_mode(w.withColumn("key", F.lower("form")), "key", "form")


BRANDS = f"{TOKENS_SQL}, n AS (SELECT execution_id, token, video, count(DISTINCT comment_id)::BIGINT AS n FROM tokens GROUP BY ALL), b AS (SELECT execution_id, token, sum(n)::BIGINT AS comments, max(n)::BIGINT AS top, arg_min(video, (-n, video)) AS dominant FROM n GROUP BY ALL)"


@query("agg_word_by_video", f"{BRANDS} SELECT execution_id, token, comments, top, dominant, top::DOUBLE / comments AS concentration FROM b")
def _(v):
    return A.word_concentration(tokens(v), "execution_id", "video", "comment_id", "token")


@query("udaf_brand_words", f"{BRANDS} SELECT execution_id, token, dominant FROM b WHERE comments >= 3 AND top::DOUBLE / comments >= 0.85")
def _(v):
    found = A.word_concentration(tokens(v), "execution_id", "video", "comment_id", "token")
    return found.where("comments >= 3 and concentration >= 0.85").select("execution_id", "token", "dominant")


@query("udaf_topic_tfidf", f"{TOKENS_SQL}, tf AS (SELECT execution_id, comment_id, token, count(*) AS tf FROM tokens GROUP BY ALL), df AS (SELECT execution_id, token, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT execution_id, count(*) AS n FROM texts GROUP BY ALL), raw AS (SELECT tf.execution_id, comment_id, tf.token, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (execution_id, token) JOIN n USING (execution_id) WHERE df >= 3 AND df <= 0.4 * n) SELECT execution_id, comment_id, count(*)::BIGINT AS tokens, round(max(w) / sqrt(sum(w * w)), 6) AS strongest FROM raw GROUP BY ALL")
def _(v):
    rows, _ = TP.vectors(tokens(v, v.dealt_texts), v.texts)
    return rows.select("execution_id", "comment_id", F.size("at").cast("long").alias("tokens"), F.round(F.array_max("cells"), 6).alias("strongest"))


def found_topics(v):
    return TP.topics_of_vectors(*TP.vectors(tokens(v, v.dealt_texts), v.texts), v.texts)


@query("udaf_topics")
def _(v):
    return found_topics(v)


@query("top_keywords")
def _(v):
    return found_topics(v).select("execution_id", "topic", "keywords").distinct()


@query("top_label_words")
def _(v):
    t = found_topics(v).select("execution_id", "topic", "keywords").distinct()
    clean = F.filter("keywords", lambda w: ~w.isin("onon", "thth"))
    return t.select("execution_id", "topic", F.array_join(F.slice(F.when(F.size(clean) >= 3, clean).otherwise(F.col("keywords")), 1, 3), " / ").alias("label"))


# Evaluation ---------------------------------------------------------------------------------------------------
PAIRS_SQL = "pairs AS (SELECT doc_id, doc_id % 10 AS fold, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS gold, CASE WHEN doc_id % 4 = 0 THEN 'neutral' WHEN toxic = 1 THEN 'negative' ELSE 'positive' END AS predicted FROM labels)"


def pairs(v):
    gold = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    predicted = F.when(F.col("doc_id") % 4 == 0, "neutral").when(F.col("toxic") == 1, "negative").otherwise("positive")
    return v.table("labels").select("doc_id", (F.col("doc_id") % 10).alias("fold"), gold.alias("gold"), predicted.alias("predicted"))


@query("agg_confusion", f"WITH {PAIRS_SQL} SELECT c.gold, " + ", ".join(f"count(*) FILTER (predicted = '{c}')::BIGINT AS as_{c}" for c in CLASSES) + " FROM (SELECT unnest(['negative', 'neutral', 'positive']) AS gold) c LEFT JOIN pairs USING (gold) GROUP BY ALL")
def _(v):
    return A.confusion(pairs(v), "gold", "predicted", CLASSES)


@query("st_accuracy", f"WITH {PAIRS_SQL} SELECT avg((gold = predicted)::INT) AS accuracy FROM pairs")
def _(v):
    return pairs(v).agg(F.avg((F.col("gold") == F.col("predicted")).cast("int")).alias("accuracy"))


PRF = f"WITH {PAIRS_SQL}, c AS (SELECT class, count(*) FILTER (gold = class AND predicted = class) AS tp, count(*) FILTER (predicted = class) AS pp, count(*) FILTER (gold = class) AS s FROM pairs, (SELECT unnest(['negative', 'neutral', 'positive']) AS class) GROUP BY ALL), m AS (SELECT class, coalesce(tp::DOUBLE / nullif(pp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(s, 0), 0) AS recall, coalesce(2 * tp::DOUBLE / nullif(pp + s, 0), 0) AS f1, s::BIGINT AS support FROM c)"


@query("st_prf_macro", f"{PRF} SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum(support)::BIGINT AS n FROM m")
def _(v):
    return E.macro(E.prf(pairs(v), "gold", "predicted", CLASSES))


@query("st_metrics_from_matrix", f"{PRF} SELECT class, precision, recall, f1, support FROM m")
def _(v):
    return E.prf(pairs(v), "gold", "predicted", CLASSES)


@query("agg_metrics_by_group", PRF.replace("GROUP BY ALL)", "GROUP BY ALL)", 1).replace("SELECT class, count(*) FILTER", "SELECT fold, class, count(*) FILTER").replace("m AS (SELECT class,", "m AS (SELECT fold, class,") + " SELECT fold, avg(f1) AS macro_f1 FROM m GROUP BY ALL")
def _(v):
    return E.macro(E.prf(pairs(v), "gold", "predicted", CLASSES, "fold"), "fold").select("fold", "macro_f1")


@query("st_cohen", f"WITH {PAIRS_SQL}, t AS (SELECT count(*)::DOUBLE AS n, avg((gold = predicted)::INT) AS po FROM pairs), e AS (SELECT sum(a::DOUBLE * b) AS s FROM (SELECT c, (SELECT count(*) FROM pairs WHERE gold = c) AS a, (SELECT count(*) FROM pairs WHERE predicted = c) AS b FROM (SELECT unnest(['negative', 'neutral', 'positive']) AS c))) SELECT n::BIGINT AS n, po AS observed, s / (n * n) AS expected, (po - s / (n * n)) / (1 - s / (n * n)) AS kappa FROM t, e")
def _(v):
    return E.cohen(pairs(v), "gold", "predicted", CLASSES)


RATINGS_SQL = "ratings AS (SELECT doc_id, r AS rater, CASE WHEN (doc_id * (r + 3)) % 7 < 2 THEN 'negative' WHEN doc_id % (r + 2) = 0 THEN 'neutral' ELSE 'positive' END AS label FROM labels, (SELECT unnest([1, 2, 3]) AS r))"


def ratings(v):
    r = F.col("rater")
    label = F.when(F.col("doc_id") * (r + 3) % 7 < 2, "negative").when(F.col("doc_id") % (r + 2) == 0, "neutral").otherwise("positive")
    return v.table("labels").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rater")).select("doc_id", "rater", label.alias("label"))


VOTES = f"WITH {RATINGS_SQL}, votes AS (SELECT doc_id, " + ", ".join(f"count(*) FILTER (label = '{c}')::BIGINT AS {c}" for c in CLASSES) + ", count(*)::BIGINT AS raters FROM ratings GROUP BY ALL)"


@query("agg_vote_counts", f"{VOTES} SELECT doc_id, negative, neutral, positive, raters FROM votes")
def _(v):
    return E.vote_counts(ratings(v), "doc_id", "label", CLASSES)


@query("agg_majority_vote", f"{VOTES} SELECT doc_id, CASE WHEN negative >= 2 THEN 'negative' WHEN neutral >= 2 THEN 'neutral' WHEN positive >= 2 THEN 'positive' END AS majority, greatest(negative, neutral, positive) AS votes FROM votes")
def _(v):
    return A.majority(ratings(v), "doc_id", "label")


@query("st_fleiss", f"{VOTES}, p AS (SELECT avg((negative * (negative - 1) + neutral * (neutral - 1) + positive * (positive - 1))::DOUBLE / 6) AS o, (sum(negative)::DOUBLE / sum(raters)) ** 2 + (sum(neutral)::DOUBLE / sum(raters)) ** 2 + (sum(positive)::DOUBLE / sum(raters)) ** 2 AS e FROM votes) SELECT o AS observed, e AS expected, (o - e) / (1 - e) AS kappa FROM p")
def _(v):
    return E.fleiss(E.vote_counts(ratings(v), "doc_id", "label", CLASSES), CLASSES)


@query("st_fleiss_class", f"{VOTES}, l AS (UNPIVOT (SELECT negative, neutral, positive FROM votes) ON negative, neutral, positive INTO NAME class VALUE n), s AS (SELECT class, sum(n * (3 - n))::DOUBLE AS split, sum(n)::DOUBLE / (3 * count(*)) AS p, count(*) AS items FROM l GROUP BY ALL) SELECT class, 1 - split / (items * 6 * p * (1 - p)) AS kappa FROM s WHERE p > 0 AND p < 1")
def _(v):
    return E.fleiss_by_class(E.vote_counts(ratings(v), "doc_id", "label", CLASSES), CLASSES)


@query("agg_divergence", f"WITH {RATINGS_SQL}, p AS (SELECT a.label AS x, b.label AS y FROM ratings a JOIN ratings b ON a.doc_id = b.doc_id AND a.rater < b.rater) SELECT x, y, count(*)::BIGINT AS n FROM (SELECT x, y FROM p UNION ALL SELECT y, x FROM p WHERE x <> y) GROUP BY ALL")
def _(v):
    return A.divergence(ratings(v), "doc_id", "rater", "label")


@query("st_human_ceiling", f"WITH {RATINGS_SQL}, {PAIRS_SQL}, c AS (SELECT a.doc_id, a.rater AS r1, b.rater AS r2, a.label AS gold FROM ratings a JOIN ratings b ON a.doc_id = b.doc_id AND a.rater < b.rater AND a.label = b.label), t AS (SELECT r.rater::VARCHAR AS judged, r.doc_id, gold, label AS predicted FROM ratings r JOIN c ON r.doc_id = c.doc_id AND r.rater NOT IN (r1, r2)), j AS (SELECT * FROM t UNION ALL SELECT 'model', d.doc_id, d.gold, p.predicted FROM (SELECT DISTINCT doc_id, gold FROM t) d JOIN pairs p USING (doc_id)) SELECT judged, count(*)::BIGINT AS n, avg((gold = predicted)::INT) AS accuracy FROM j GROUP BY ALL")
def _(v):
    judged = E.human_ceiling(ratings(v), "doc_id", "rater", "label", pairs(v).select("doc_id", "predicted"))
    return judged.groupBy("judged").agg(F.count("*").alias("n"), F.avg((F.col("gold") == F.col("predicted")).cast("int")).alias("accuracy"))


@query("set_tiebreak_union", f"{VOTES} SELECT doc_id FROM votes WHERE greatest(negative, neutral, positive) = 1 UNION SELECT doc_id FROM labels WHERE doc_id % 11 = 0")
def _(v):
    ties = A.majority(ratings(v), "doc_id", "label").where("majority is null").select("doc_id")
    return ties.union(v.table("labels").where("doc_id % 11 = 0").select("doc_id")).distinct()


@query("agg_label_distribution", f"WITH {PAIRS_SQL} SELECT gold, count(*)::BIGINT AS n, count(*) > 0.85 * sum(count(*)) OVER () OR count(*) < 0.05 * sum(count(*)) OVER () AS suspicious FROM pairs GROUP BY gold")
def _(v):
    n = pairs(v).groupBy("gold").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("gold", "n", ((F.col("n") > 0.85 * F.col("t")) | (F.col("n") < 0.05 * F.col("t"))).alias("suspicious"))


@query("agg_prediction_divergence", f"WITH {PAIRS_SQL} SELECT count(*) FILTER (gold <> predicted)::BIGINT AS n FROM pairs")
def _(v):
    return pairs(v).agg(F.count_if(F.col("gold") != F.col("predicted")).alias("n"))


@query("join_align_by_id", f"WITH {PAIRS_SQL} SELECT fold, count(*)::BIGINT AS aligned FROM pairs JOIN documents USING (doc_id) GROUP BY ALL")
def _(v):
    return pairs(v).join(v.table("documents").select("doc_id"), "doc_id").groupBy("fold").agg(F.count("*").alias("aligned"))


@query("st_percentile", "SELECT lang, quantile_cont(n_chars::DOUBLE, 0.95) AS p95, quantile_cont(n_chars::DOUBLE, 0.5) AS p50 FROM documents GROUP BY lang")
def _(v):
    return E.quantiles(v.table("documents"), F.col("n_chars").cast("double"), {"p95": 0.95, "p50": 0.5}, "lang")


@query("agg_token_lengths", "SELECT lang, count(*)::BIGINT AS n, max(CASE WHEN i = least(n - 1, 50 * n // 100) THEN n_chars END) AS p50, max(CASE WHEN i = least(n - 1, 95 * n // 100) THEN n_chars END) AS p95 FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) GROUP BY lang")
def _(v):
    return A.index_percentiles(v.table("documents"), "lang", "n_chars", (50, 95))


@query("agg_seed_stats", "SELECT event_type, avg(value) AS mean, stddev_samp(value) AS deviation, min(value) AS low, median(value) AS middle, max(value) AS high FROM events GROUP BY ALL")
def _(v):
    x = F.col("value")
    return v.table("events").groupBy("event_type").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("deviation"), F.min(x).alias("low"), F.max(x).alias("high")).join(
        E.quantiles(v.table("events"), x, {"middle": 0.5}, "event_type"), "event_type"
    )


@query("agg_latency", "SELECT user_id, avg(value) AS mean, median(value) AS middle, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY ALL")
def _(v):
    x = F.col("value")
    return v.table("events").groupBy("user_id").agg(F.avg(x).alias("mean")).join(E.quantiles(v.table("events"), x, {"middle": 0.5, "p95": 0.95}, "user_id"), "user_id")


@query("st_bootstrap_f1")
def _(v):
    return E.bootstrap_macro_f1(pairs(v), "gold", "predicted", CLASSES)


@query("st_bootstrap_cluster")
def _(v):
    return E.bootstrap_macro_f1(pairs(v), "gold", "predicted", CLASSES, "fold")


# Samples ------------------------------------------------------------------------------------------------------
@query("st_class_weights", f"WITH {PAIRS_SQL}, n AS (SELECT gold, count(*) AS n FROM pairs GROUP BY ALL) SELECT gold, n::BIGINT AS n, (SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n) * n) AS weight FROM n")
def _(v):
    return S.class_weights(pairs(v), "gold")


@query("st_stratified_split")
def _(v):
    return S.split(pairs(v), "gold", "doc_id").select("doc_id", "gold", "side")


@query("st_stratified_folds")
def _(v):
    return S.folds(pairs(v), "gold", "doc_id").select("doc_id", "gold", F.col("fold").alias("deal"))


@query("st_round_robin_quota")
def _(v):
    return S.round_robin(pairs(v), "gold", "doc_id", 60).select("doc_id", "gold", "place")


@query("st_stratified_sample", f"WITH {PAIRS_SQL} SELECT doc_id, gold FROM (SELECT doc_id, gold, row_number() OVER (PARTITION BY gold ORDER BY md5('42:' || doc_id), doc_id) AS place FROM pairs) WHERE place <= 20")
def _(v):
    """The members of a sample of 20 a class."""
    return S.within(pairs(v), "gold", "doc_id").where("place <= 20").select("doc_id", "gold")


# Twins --------------------------------------------------------------------------------------------------------
@query("set_jaccard", "SELECT a.doc_id, len(list_intersect(a.w, b.w))::DOUBLE / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) AS jaccard FROM (SELECT doc_id, list_distinct(string_split(text, ' ')) AS w FROM documents) a JOIN (SELECT doc_id - 1 AS doc_id, list_distinct(string_split(text, ' ')) AS w FROM documents) b USING (doc_id)")
def _(v):
    w = v.table("documents").select("doc_id", F.array_distinct(F.split("text", " ")).alias("w"))
    both = w.join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("u")), "doc_id")
    return both.select("doc_id", A.fraction(F.size(F.array_intersect("w", "u")), F.size(F.array_union("w", "u"))).alias("jaccard"))


# Queue, quota, retention --------------------------------------------------------------------------------------
@query("dt_quota_day", "SELECT event_id AS job_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS day FROM events")
def _(v):
    return v.jobs.select("job_id", L.quota_day(F.col("at")).alias("day"))


@query("dt_next_renewal", "SELECT event_id AS job_id, epoch_us((CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) + INTERVAL 1 DAY) AT TIME ZONE 'America/Los_Angeles') AS renewal_us FROM events")
def _(v):
    return v.jobs.select("job_id", F.unix_micros(L.next_renewal(F.col("at"))).alias("renewal_us"))


@query("dt_available_until", "SELECT o_orderkey, epoch_us(o_orderdate + INTERVAL 29 DAYS) AS until_us FROM orders")
def _(v):
    return v.table("orders").select("o_orderkey", F.unix_micros((F.col("o_orderdate") + F.expr("INTERVAL 29 DAYS")).cast("timestamp")).alias("until_us"))


@query("dt_parse_iso", "SELECT event_id AS job_id, epoch_us(ts) AS at_us FROM events")
def _(v):
    iso = F.concat(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return v.jobs.select("job_id", F.unix_micros(F.try_to_timestamp(iso)).alias("at_us"))


@query("dt_cut_start", "SELECT o_orderkey, epoch_us(date_trunc('day', o_orderdate) + INTERVAL 3 HOURS) AS cut_us FROM orders")
def _(v):
    return v.table("orders").select("o_orderkey", F.unix_micros(F.to_utc_timestamp(F.to_date("o_orderdate").cast("timestamp"), "-03:00")).alias("cut_us"))


SPENT = "WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id AS tenant_id, sum(floor(value)::BIGINT)::BIGINT AS mine FROM events GROUP BY ALL), t AS (SELECT *, (sum(mine) OVER (PARTITION BY day))::BIGINT AS total FROM d)"


@query("st_quota_budget", f"{SPENT} SELECT day, tenant_id, greatest(0, least(9500 - total, greatest(2000 - mine, 7000 - total)))::BIGINT AS budget FROM t")
def _(v):
    mine = v.jobs.groupBy(F.to_date("at").alias("day"), "tenant_id").agg(F.sum("units").alias("mine"))
    total = mine.groupBy("day").agg(F.sum("mine").alias("total"))
    return mine.join(total, "day").select("day", "tenant_id", L.budget(F.col("total"), F.col("mine")).cast("long").alias("budget"))


@query("st_quota_cost", "SELECT o_orderkey, least(2000, ceil(floor(o_totalprice) / 100) + ceil((o_custkey % 70) / 50) + o_custkey % 70)::BIGINT AS cost FROM orders")
def _(v):
    k = F.col("o_custkey") % 70
    return v.table("orders").select("o_orderkey", L.cost(F.floor("o_totalprice"), k).cast("long").alias("cost"))


@query("st_even_share")
def _(v):
    wanted = F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 5 + 1).cast("int")), lambda i: (i * i * 7).cast("long"))
    return v.table("customer").select("c_custkey", L.even_share(F.lit(40), wanted).alias("taken"))


STATUS = "CASE event_type WHEN 'view' THEN 'pendente' WHEN 'click' THEN 'processando' WHEN 'error' THEN 'erro' ELSE 'concluida' END"


def queue(v):
    status = F.when(F.col("event_type") == "view", "pendente").when(F.col("event_type") == "click", "processando").when(F.col("event_type") == "error", "erro").otherwise("concluida")
    return v.jobs.select("job_id", (F.col("tenant_id") % 3).alias("kind"), status.alias("status"), F.col("at").alias("created_at"), F.lit(None).cast("timestamp").alias("available_at"), F.lit(None).cast("timestamp").alias("claimed_at"), (F.col("units") % 7).alias("attempts"), F.col("tenant_id").alias("model_id"))


def now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


@query("state_claim", "SELECT user_id % 3 AS kind, arg_min(event_id, (ts, event_id)) AS job_id FROM events WHERE event_type = 'view' GROUP BY ALL")
def _(v):
    return L.claim(queue(v), "kind", now())


@query("top_queue_head", "SELECT arg_min(event_id, (ts, event_id)) AS job_id FROM events WHERE event_type = 'view'")
def _(v):
    return queue(v).where("status = 'pendente'").agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))


@query("state_reap", "SELECT event_id AS job_id, CASE WHEN floor(value)::BIGINT % 7 > 4 THEN 'dlq' ELSE 'pendente' END AS becomes FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 15 MINUTES")
def _(v):
    return L.reap(queue(v), now()).select("job_id", "becomes")


@query("state_single_active", "SELECT user_id AS model_id, count(*)::BIGINT AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL HAVING count(*) > 1")
def _(v):
    return L.double_active(queue(v))


@query("state_waiting", "SELECT event_id AS job_id FROM events WHERE event_type = 'view' AND ts > TIMESTAMP '2024-01-20'")
def _(v):
    return queue(v).where((F.col("status") == "pendente") & (F.col("created_at") > now())).select("job_id")


@query("state_next_stage", "SELECT event_id AS job_id, CASE user_id % 3 WHEN 0 THEN 'inferencia' WHEN 1 THEN 'topicos' END AS next FROM events")
def _(v):
    stage = F.element_at(F.array(*map(F.lit, ("coleta", "inferencia", "topicos"))), (F.col("tenant_id") % 3 + 1).cast("int"))
    return v.jobs.select("job_id", L.next_stage(stage).alias("next"))


@query("ret_comment_text", "SELECT doc_id, CASE WHEN DATE '2024-01-01' + (doc_id % 60)::INT < DATE '2024-02-20' - 29 THEN NULL ELSE md5(text) END AS digest FROM documents")
def _(v):
    d = v.table("documents").withColumn("started", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).cast("timestamp"))
    out = L.purge_comments(d, "started", F.lit("2024-02-20").cast("timestamp"))
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("ret_results", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01' - INTERVAL 1095 DAYS")
def _(v):
    o = v.table("orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("completed_at"))
    return L.purge_results(o, F.lit("2000-06-01").cast("timestamp")).select("o_orderkey")


@query("ret_cascade_tenant", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")
def _(v):
    gone = v.table("orders").where("o_custkey = 7").select(F.col("o_orderkey").alias("l_orderkey"))
    return v.table("lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("src_comments_api", """
WITH c AS (SELECT source AS video, doc_id::VARCHAR AS id, (DATE '2024-01-01' + (doc_id % 50)::INTEGER)::VARCHAR AS day, text FROM documents WHERE source IS NOT NULL),
r AS (SELECT video, id, day, CASE WHEN day < '2024-01-10' THEN 'date' WHEN NOT contains(lower(coalesce(text, '')), 'on') THEN 'term' END AS reason FROM c),
k AS (SELECT *, row_number() OVER w - 1 AS k, coalesce(sum((reason IS NULL)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WINDOW w AS (PARTITION BY video ORDER BY day DESC, id)),
stop AS (SELECT video, min(k // 100) FILTER (reason = 'date') AS page FROM k GROUP BY video)
SELECT video, reason, count(*)::BIGINT AS n FROM k JOIN stop USING (video) WHERE before < 20 AND k // 100 <= coalesce(page, k // 100) GROUP BY video, reason""")
def _(v):
    """What a collection of every video accepts and leaves out, read page by page from landed pages."""
    at = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("comment_id") % 50).cast("int")).cast("string")
    path = shared_folder(v.spark)
    paged.land(v.texts.select("video", "comment_id", at.alias("published_at"), "text"), path)
    read = paged.comments(v.spark, path, limit=20, after="2024-01-10", term="on")
    return read.groupBy("video", "reason").agg(F.count("*").alias("n"))


# JSON, files --------------------------------------------------------------------------------------------------
@query("json_video_count", "SELECT event_id AS job_id, coalesce(len(json_keys(props)), 0)::INT AS n FROM events")
def _(v):
    return v.jobs.select("job_id", F.coalesce(F.size(F.map_keys(F.from_json("props", "map<string,string>"))), F.lit(0)).alias("n"))


@query("flt_unknown_keys", "SELECT event_id AS job_id, array_to_string(list_filter(json_keys(props), lambda k: k NOT IN ('videos', 'limit')), ',') AS unknown FROM events")
def _(v):
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    return v.jobs.select("job_id", F.array_join(F.array_except(keys, F.array(F.lit("videos"), F.lit("limit"))), ",").alias("unknown"))


@query("json_payload_merge", "SELECT event_id AS job_id, (props->>'$.k')::INT AS k, event_type AS kind FROM events")
def _(v):
    merged = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.col("event_type")))
    return v.jobs.select("job_id", merged["k"].cast("int").alias("k"), merged["kind"].alias("kind"))


@query("json_prompt_batches", "SELECT lang, floor((r - 1) / 25)::BIGINT AS batch, count(*)::BIGINT AS n FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) GROUP BY ALL")
def _(v):
    placed = S.numbered(v.table("documents").select("lang", "doc_id"), ["lang"], F.shiftright("doc_id", 16), [F.col("doc_id")])
    return placed.select("lang", F.floor((F.col("place") - 1) / 25).alias("batch")).groupBy("lang", "batch").agg(F.count("*").alias("n"))


@query("src_label_csv", "SELECT reason, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l = 'x' THEN 'unknown label' WHEN l = '' THEN 'empty' END AS reason FROM (SELECT CASE doc_id % 10 WHEN 0 THEN 'x' WHEN 1 THEN '' ELSE 'positivo' END AS l FROM documents)) WHERE reason IS NOT NULL GROUP BY ALL")
def _(v):
    label = F.when(F.col("doc_id") % 10 == 0, "x").when(F.col("doc_id") % 10 == 1, "").otherwise("positivo")
    rows = v.table("documents").select(F.col("doc_id").cast("string").alias("id"), label.alias("label"), F.col("doc_id").alias("at"))
    return files.validate_labels(through_csv(rows).withColumn("at", F.col("at").cast("long")), "id", "label", "at")[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("src_api_errors", "SELECT event_type, CASE event_type WHEN 'error' THEN 'transient' WHEN 'view' THEN 'empty' WHEN 'click' THEN 'quota' ELSE 'permanent' END AS class, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def _(v):
    t = F.col("event_type")
    status = F.when(t == "error", 503).otherwise(403)
    reason = F.when(t == "view", "commentsDisabled").when(t == "click", "quotaExceeded").otherwise("forbidden")
    return v.jobs.groupBy("event_type", files.api_error(status, reason).alias("class")).agg(F.count("*").alias("n"))


@query("set_missing_videos", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(v):
    known = v.table("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return v.table("orders").select("o_custkey").distinct().join(known, "o_custkey", "left_anti")


@query("set_single_channel", "SELECT lang, count(DISTINCT source)::BIGINT AS channels, count(DISTINCT source) > 1 AS rejected FROM documents GROUP BY ALL")
def _(v):
    return v.table("documents").groupBy("lang").agg(F.count_distinct("source").alias("channels"), (F.count_distinct("source") > 1).alias("rejected"))


@query("set_rater_union_intersection", f"WITH {RATINGS_SQL} SELECT doc_id, count(DISTINCT rater) = 3 AS covered FROM ratings WHERE (doc_id + rater) % 9 > 0 GROUP BY ALL")
def _(v):
    return ratings(v).where("(doc_id + rater) % 9 > 0").groupBy("doc_id").agg((F.count_distinct("rater") == 3).alias("covered"))


@query("prj_short_text", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(trim(text), '\\S+')) <= 3")
def _(v):
    return v.table("documents").where(F.size(F.regexp_extract_all(F.trim("text"), F.lit(r"\S+"), F.lit(0))) <= 3).select("doc_id")


@query("prj_video_title_fallback", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END, ''), 'ID ' || doc_id) AS title FROM documents")
def _(v):
    t = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source"))
    return v.table("documents").select("doc_id", F.coalesce(F.nullif(t, F.lit("")), F.concat(F.lit("ID "), F.col("doc_id").cast("string"))).alias("title"))

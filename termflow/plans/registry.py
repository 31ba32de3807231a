"""The registered queries of the engine and their DuckDB equivalents.

Each query runs one or more operators over whole tables; `SQL` holds the same result in plain SQL.
Counts are BIGINT on both sides, and ratios stay unrounded doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termflow.functions import naming as N
from termflow.functions import text as T
from termflow.operators import controls, corpus, frequency, mining, summary, terms, vocabulary
from termflow.sources.staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tokens_of(table(spark, sf_dir, "documents"))


#: Tokens as SQL: lower-cased runs of letters with their place in the text.
TOKENS = r"""tok AS (SELECT doc_id, lang, source, unnest(range(len(ws))) AS ord, unnest(ws) AS token FROM (
    SELECT doc_id, lang, source, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}]+'), lambda w: w <> '') AS ws FROM documents))"""
#: Sentences of documents as SQL; the texts hold no readings in parentheses.
SENTENCES = r"""lines AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
    parts AS (SELECT doc_id, line, unnest(range(len(ps))) AS part, unnest(ps) AS p FROM (SELECT doc_id, line, string_split_regex(trim(l), '[。！？｡!?.]+') AS ps FROM lines)),
    sent AS (SELECT * FROM (SELECT doc_id, line, part, trim(regexp_replace(trim(p), '</?[a-zA-Z][^<>]*>|\{\\[^}]*\}', '', 'g')) AS text FROM parts) WHERE text <> '')"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line, part, text of all sentences."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "l"))
    return lines.select("doc_id", "line", F.posexplode(T.split_sentences(F.col("l"))).alias("part", "text"))


@query("term_frequency_rank", f"""WITH {TOKENS}, c AS (SELECT token AS term, count(*) AS n FROM tok GROUP BY token HAVING count(*) > 1)
    SELECT term, n, rank() OVER (ORDER BY n DESC) AS rank FROM c""")
def term_frequency_rank(spark, sf_dir):
    counts = tokens(spark, sf_dir).groupBy(F.col("token").alias("term")).agg(F.count("*").alias("n"))
    return corpus.ranked(counts, drop_hapax=True).select("term", "n", F.col("rank").cast("long").alias("rank"))


@query("term_counts_by_lang", f"""WITH {TOKENS} SELECT lang, token AS term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok GROUP BY lang, token""")
def term_counts_by_lang(spark, sf_dir):
    t = tokens(spark, sf_dir)
    words = t.select(F.col("token").alias("surface"), F.col("lang").alias("surface_reading"), F.col("token").alias("full_segment"), F.col("lang").alias("full_reading"), F.lit("Noun").alias("pos"))
    counts = corpus.count_surfaces(words, any_script=True).select(F.col("reading").alias("lang"), F.col("surface").alias("term"), "n")
    docs = t.groupBy("lang", F.col("token").alias("term")).agg(F.countDistinct("doc_id").alias("n_docs"))
    return counts.join(docs, ["lang", "term"]).select("lang", "term", "n", "n_docs")


@query("sentence_split_stats", f"""WITH {SENTENCES} SELECT doc_id, count(*) AS n_sentences, sum(length(text))::BIGINT AS n_chars FROM sent GROUP BY doc_id""")
def sentence_split_stats(spark, sf_dir):
    return sentences(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("strip_tags_length", r"""SELECT page_id, length(regexp_replace(html, '(?i)</?[a-z][^<>]*>|\{\\[^}]*\}', '', 'g'))::BIGINT AS n_chars FROM pages""")
def strip_tags_length(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.strip_tags(F.col("html"))).cast("long").alias("n_chars"))


@query("entity_decode", """SELECT page_id, md5(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS digest FROM pages""")
def entity_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.decode_entities(F.col("html"))).alias("digest"))


@query("text_filters_applied", r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '[（(][^（）()]*[）)]', '', 'g'), '【[^【】]*】', '', 'g'), '[0-9]+', '#', 'g')) AS text FROM conversations""")
def text_filters_applied(spark, sf_dir):
    filters = T.compile_filters(spark, ["lenticular", "parentheses"], [("[0-9]+", "#", True), ("[unclosed", "", True), ("x", "y", False)])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.apply_filters(F.col("text"), filters).alias("text"))


@query("sentence_key_dedupe", rf"""WITH {SENTENCES} SELECT regexp_replace(replace(regexp_replace(text, '<[^>]*(>|$)', '', 'g'), '&nbsp;', ' '), '\s+', '', 'g') AS key, count(*) AS n, min(doc_id) AS first_doc FROM sent GROUP BY 1""")
def sentence_key_dedupe(spark, sf_dir):
    return sentences(spark, sf_dir).groupBy(T.sentence_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("dedupe_first_by_key", rf"""WITH {SENTENCES}, k AS (SELECT *, regexp_replace(text, '\s+', '', 'g') AS key FROM sent)
    SELECT doc_id, line, part, text FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, line, part) AS rn FROM k) WHERE rn = 1""")
def dedupe_first_by_key(spark, sf_dir):
    return terms.first_of_key(sentences(spark, sf_dir), [T.sentence_key(F.col("text"), tags=False)], ["doc_id", "line", "part"])


@query("corpus_source_sizes", """SELECT source, sum(n_chars)::BIGINT AS size, count(*) AS n FROM documents GROUP BY source""")
def corpus_source_sizes(spark, sf_dir):
    return corpus.source_sizes(table(spark, sf_dir, "documents").select("source", F.col("n_chars").alias("size")))


@query("corpus_balance", """WITH s AS (SELECT source, sum(n_chars) AS total FROM documents GROUP BY source),
    r AS (SELECT total, row_number() OVER (ORDER BY total, source) AS nth, count(*) OVER () AS n FROM s),
    t AS (SELECT sum(total) // count(*) AS target, max(n) AS n FROM r WHERE nth > n // 20 AND nth <= n - n // 20),
    d AS (SELECT doc_id, d.source, n_chars, total, coalesce(sum(n_chars) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents d JOIN s ON d.source = s.source)
    SELECT doc_id AS file_id, source, n_chars AS size, target::BIGINT AS target FROM d, t WHERE n <= 1 OR total <= target OR before < target""")
def corpus_balance(spark, sf_dir):
    return corpus.balance(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "source", F.col("n_chars").alias("size")))


def _preview(spark, sf_dir):
    counts = tokens(spark, sf_dir).groupBy(F.col("token").alias("term")).agg(F.count("*").alias("n"))
    return corpus.preview(counts, [("n", True), ("term", False)])


@query("preview_top", f"WITH {TOKENS} SELECT token AS term, count(*) AS n FROM tok GROUP BY token ORDER BY n DESC, term LIMIT 250")
def preview_top(spark, sf_dir):
    return _preview(spark, sf_dir)[0]


@query("preview_bottom", f"WITH {TOKENS} SELECT token AS term, count(*) AS n FROM tok GROUP BY token ORDER BY n, term DESC LIMIT 250")
def preview_bottom(spark, sf_dir):
    return _preview(spark, sf_dir)[1]


#: A small ignore list, as a list of its own would be.
IGNORED = ["the", "of", "and", "de", "la", "der", "die", "en", "to", "in"]


@query("ignore_partition", f"""WITH {TOKENS} SELECT CASE WHEN token IN ({", ".join(f"'{w}'" for w in IGNORED)}) THEN 'ignored' WHEN token IN (SELECT lower(split_part(p_name, ' ', 1)) FROM part) THEN 'known' ELSE 'unknown' END AS status,
    count(*) AS n, count(DISTINCT token) AS n_terms FROM tok GROUP BY 1""")
def ignore_partition(spark, sf_dir):
    ignore = spark.createDataFrame([(w, "manual", True) for w in IGNORED] + [("is", "file", False)], "term string, origin string, enabled boolean")
    known = table(spark, sf_dir, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("lemma"))
    counts = tokens(spark, sf_dir).groupBy(F.col("token").alias("lemma")).agg(F.count("*").alias("n"))
    return vocabulary.split_ignored(counts, ignore, known).groupBy("status").agg(F.sum("n").alias("n"), F.count("*").alias("n_terms"))


@query("level_lookup_min", """WITH e AS (SELECT lower(split_part(p_name, ' ', 1)) AS kanji, lower(split_part(p_name, ' ', 2)) AS kana, (p_size % 5)::INT AS lv FROM part),
    t AS (SELECT form, kana, min(lv) AS level_ord FROM (SELECT kana AS form, kana, lv FROM e UNION ALL SELECT kanji, kana, lv FROM e WHERE kanji <> '') GROUP BY form, kana),
    w AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS lemma, lower(split_part(p_name, ' ', 2)) AS lemma_reading FROM part UNION SELECT DISTINCT lower(split_part(p_name, ' ', 2)), lower(split_part(p_name, ' ', 2)) FROM part)
    SELECT lemma, lemma_reading, 'N' || (5 - level_ord) AS level FROM w LEFT JOIN t ON lemma = form AND lemma_reading = kana""")
def level_lookup_min(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    word = lambda k: F.lower(F.split_part("p_name", F.lit(" "), F.lit(k)))
    jlpt = part.select(word(1).alias("kanji"), word(2).alias("kana"), F.concat(F.lit("N"), (5 - F.col("p_size") % 5).cast("string")).alias("level"))
    words = part.select(word(1).alias("lemma"), word(2).alias("lemma_reading")).union(part.select(word(2), word(2))).distinct()
    return vocabulary.with_level(words, jlpt).select("lemma", "lemma_reading", "level")


WEIGHTS = {"click": 1.0, "view": 0.5, "purchase": 2.0}


@query("weighted_harmonic", """WITH d AS (SELECT event_type AS dict, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)),
    e AS (SELECT user_id, event_type, min(floor(value * 10))::BIGINT AS f FROM events GROUP BY user_id, event_type)
    SELECT user_id, coalesce(round(sum(CASE WHEN f > 0 THEN k * 0.5::DOUBLE END) / sum(CASE WHEN f > 0 THEN k * 0.5::DOUBLE / f END))::BIGINT, 4294967295) AS weighted, round(count(CASE WHEN f > 0 THEN 1 END) / sum(CASE WHEN f > 0 THEN 1.0::DOUBLE / f END))::BIGINT AS plain
    FROM e JOIN d ON event_type = dict GROUP BY user_id""")
def weighted_harmonic(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    state = events.select(F.col("event_type").alias("dict")).distinct().select("dict", (F.row_number().over(Window.orderBy("dict")) * 0.5).alias("weight"), F.lit(True).alias("enabled"))
    found = events.groupBy("user_id", F.col("event_type").alias("dict")).agg(F.min(F.floor(F.col("value") * 10)).alias("value"))
    df = frequency.enabled(found, state)
    return df.groupBy("user_id").agg(frequency.weighted_harmonic(F.col("value"), F.col("weight")).alias("weighted"), frequency.harmonic(F.col("value")).alias("plain"))


@query("pair_frequency_fallback", """WITH e AS (SELECT p_brand AS dict, split_part(p_name, ' ', 1) AS term, CASE WHEN p_size % 3 = 0 THEN NULL ELSE split_part(p_name, ' ', 2) END AS reading, p_size::BIGINT AS value, p_partkey AS entry_ord FROM part),
    p AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word, split_part(p_name, ' ', 3) AS reading FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) FROM part),
    d AS (SELECT p.word, p.reading, e.dict, min(CASE WHEN e.reading = p.reading THEN value END) AS exact, coalesce(bool_or(e.reading <> p.reading), false) AS other, arg_min(value, CASE WHEN e.reading IS NULL THEN entry_ord END) AS simple
          FROM p JOIN e ON word = term GROUP BY p.word, p.reading, e.dict),
    h AS (SELECT word, reading, round(count(CASE WHEN exact > 0 THEN 1 END) / sum(CASE WHEN exact > 0 THEN 1.0::DOUBLE / exact END))::BIGINT AS x, count(exact) AS n, bool_or(other) AS other, round(count(CASE WHEN simple > 0 THEN 1 END) / sum(CASE WHEN simple > 0 THEN 1.0::DOUBLE / simple END))::BIGINT AS s FROM d GROUP BY word, reading)
    SELECT word, reading, CASE WHEN n > 0 THEN x WHEN NOT other THEN s END AS frequency FROM h WHERE CASE WHEN n > 0 THEN x WHEN NOT other THEN s END IS NOT NULL""")
def pair_frequency_fallback(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    entries = part.select(F.col("p_brand").alias("dict"), word(1).alias("term"), F.when(F.col("p_size") % 3 != 0, word(2)).alias("reading"), F.col("p_size").cast("long").alias("value"), F.lit(False).alias("kana_marker"), F.col("p_partkey").alias("entry_ord"))
    pairs = part.select(word(1).alias("word"), word(3).alias("reading")).union(part.select(word(1), word(2))).distinct().withColumn("pair_id", F.concat_ws("\x1f", "word", "reading"))
    found = frequency.pair_frequency(pairs, entries)
    return pairs.join(found, "pair_id").select("word", "reading", "frequency")


@query("frequency_lookup", """WITH f AS (SELECT o_orderpriority AS dict, o_custkey AS term, o_orderstatus AS reading, floor(o_totalprice)::BIGINT AS value, o_orderkey AS entry_ord FROM orders),
    g AS (SELECT dict, term, CASE WHEN entry_ord % 4 = 0 THEN NULL ELSE reading END AS reading, value, entry_ord FROM f),
    w AS (SELECT c_custkey AS word, (SELECT min(o_orderstatus) FROM orders WHERE o_custkey = c_custkey) AS reading FROM customer),
    m AS (SELECT word, dict, CASE WHEN g.reading = w.reading THEN 0 WHEN g.reading IS NULL THEN 1 END AS rk, CASE WHEN g.reading = w.reading THEN value ELSE entry_ord END AS wi, value, entry_ord FROM w JOIN g ON word = term)
    SELECT word_id, dict, value FROM (SELECT word AS word_id, dict, value, row_number() OVER (PARTITION BY word, dict ORDER BY rk, wi, entry_ord) AS rn FROM m WHERE rk IS NOT NULL) WHERE rn = 1""")
def frequency_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    freq = orders.select(F.col("o_orderpriority").alias("dict"), F.col("o_custkey").alias("term"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("reading"), F.floor("o_totalprice").alias("value"), F.lit(False).alias("kana_marker"), F.col("o_orderkey").alias("entry_ord"))
    readings = orders.groupBy("o_custkey").agg(F.min("o_orderstatus").alias("reading"))
    words = table(spark, sf_dir, "customer").join(readings, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("word_id"), F.col("c_custkey").alias("word"), "reading", F.lit(False).alias("is_kana"))
    return frequency.lookup(words, freq)


@query("known_vocab_best_match", """WITH v AS (SELECT c_custkey AS vocab_idx, c_mktsegment AS term, lower(c_mktsegment) || (c_custkey % 7) AS reading, (c_custkey % 40)::DOUBLE AS ivl FROM customer),
    f AS (SELECT s_suppkey AS form_id, m AS word, lower(m) || (s_suppkey % 9) AS reading FROM supplier, (SELECT DISTINCT c_mktsegment AS m FROM customer) x),
    k AS (SELECT DISTINCT form_id, word, f.reading AS reading, v.vocab_idx, v.term, v.reading AS vr, ivl FROM f JOIN v ON f.word = v.term OR f.reading = v.reading),
    s AS (SELECT *, CASE WHEN word = term AND reading = vr THEN 1.0 WHEN word = term THEN 0.85 WHEN reading = vr THEN 0.55 ELSE 0.0 END AS score, CASE WHEN reading = vr THEN 0 ELSE 1 END AS key_rank FROM k)
    SELECT form_id, word, score::DOUBLE AS score, vocab_idx FROM (SELECT *, row_number() OVER (PARTITION BY form_id, word ORDER BY score DESC, key_rank, vocab_idx) AS rn FROM s WHERE score > 0) WHERE rn = 1""")
def known_vocab_best_match(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    vocab = customer.select(F.col("c_custkey").alias("vocab_idx"), F.col("c_mktsegment").alias("term"), F.concat(F.lower("c_mktsegment"), (F.col("c_custkey") % 7).cast("string")).alias("reading"), (F.col("c_custkey") % 40).cast("double").alias("interval"))
    segments = [r[0] for r in customer.select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(10).collect()]  # the schema has five
    forms = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(*map(F.lit, segments))).alias("word"))
    forms = forms.select(F.struct("s_suppkey", "word").alias("form_id"), "word", F.concat(F.lower("word"), (F.col("s_suppkey") % 9).cast("string")).alias("reading"), F.lit("Noun").alias("pos"))
    return vocabulary.best_match(forms, vocab).select(F.col("form_id.s_suppkey").alias("form_id"), F.col("form_id.word").alias("word"), "score", "vocab_idx")


@query("comprehension_by_group", """WITH l AS (SELECT l_orderkey, l_partkey, CASE WHEN (l_quantity + 1) / 31.0::DOUBLE >= 1 THEN 1.0::DOUBLE ELSE ln(l_quantity::DOUBLE + 1) / ln(31.0::DOUBLE) END AS c FROM lineitem),
    t AS (SELECT l_orderkey, l_partkey, min(c) AS c FROM l GROUP BY l_orderkey, l_partkey), s AS (SELECT l_orderkey, avg(c) AS c FROM t GROUP BY l_orderkey)
    SELECT o_custkey AS source_id, floor(avg(coalesce(c, 0)) * 1000 + 0.5)::BIGINT AS mille, count(*) AS n_sentences FROM orders LEFT JOIN s ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def comprehension_by_group(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sentence_id"), F.col("l_partkey").alias("term_id"), vocabulary.comprehension(F.col("l_quantity")).alias("comprehension"))
    items = items.groupBy("sentence_id", "term_id").agg(F.min("comprehension").alias("comprehension"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sentence_id"), F.col("o_custkey").alias("source_id"))
    df = vocabulary.file_comprehension(vocabulary.sentence_comprehension(orders, items))
    return df.select("source_id", F.floor(F.col("comprehension") * 1000 + 0.5).alias("mille"), "n_sentences")


@query("frequency_bands", f"""WITH {TOKENS}, c AS (SELECT token, count(*) AS n FROM tok GROUP BY token), r AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rank FROM c),
    b(low, high, band) AS (VALUES {", ".join(str(x) for x in summary.BANDS)}), d AS (SELECT band, low, least(high, (SELECT count(*) FROM c)) AS high FROM b),
    s AS (SELECT band, high - low + 1 AS total, count(token) AS n, sum(CASE WHEN n >= 30 THEN 1.0::DOUBLE ELSE ln(n::DOUBLE + 1) / ln(31.0::DOUBLE) END) AS c FROM d LEFT JOIN (SELECT * FROM r WHERE n > 2) r ON rank BETWEEN low AND high WHERE high >= low GROUP BY band, low, high)
    SELECT band, total::BIGINT AS total, least(coalesce(n / total, 0), 1.0)::DOUBLE AS coverage, floor(least(coalesce(c / total, 0), 1) * 1000000 + 0.5)::BIGINT AS comprehension_millionths FROM s""")
def frequency_bands(spark, sf_dir):
    counts = tokens(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))
    # ranks beyond the last band don't count, so only a top-k is ever numbered
    top = counts.orderBy(F.desc("n"), "token").limit(summary.BANDS[-1][1])
    ranked = top.select("token", "n", F.row_number().over(Window.orderBy(F.desc("n"), "token")).alias("rank"))
    known = ranked.filter("n > 2").select("rank", F.col("n").alias("interval"))
    df = summary.rank_bands(known, counts.count())
    return df.select("band", "total", "coverage", F.floor(F.col("comprehension") * 1000000 + 0.5).alias("comprehension_millionths"))


EVENT_SECONDS = "epoch_us(ts::TIMESTAMP) // 1000000"


@query("span_overlap_min", f"""WITH e AS (SELECT event_id, user_id, event_type, {EVENT_SECONDS} AS s FROM events),
    seg AS (SELECT event_id, user_id, s AS a, s + 600 AS b FROM e WHERE event_type = (SELECT min(event_type) FROM events)), sp AS (SELECT user_id, s AS a, s + 3600 AS b, (event_id % 4)::INT AS k FROM e WHERE event_type = (SELECT max(event_type) FROM events))
    SELECT event_id AS seg_id, coalesce(min(k), -1)::INT AS knowledge FROM seg LEFT JOIN sp ON seg.user_id = sp.user_id AND sp.a < seg.b AND sp.b > seg.a GROUP BY event_id""")
def span_overlap_min(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("unix_seconds(cast(ts as timestamp))").alias("s"))
    ends = e.agg(F.min("event_type"), F.max("event_type")).first()
    seg = e.filter(F.col("event_type") == ends[0]).select("user_id", F.col("event_id").alias("seg_id"), F.col("s").alias("seg_start"), (F.col("s") + 600).alias("seg_end"))
    spans = e.filter(F.col("event_type") == ends[1]).select("user_id", F.col("s").alias("start"), (F.col("s") + 3600).alias("end"), (F.col("event_id") % 4).cast("int").alias("knowledge"))
    return terms.span_knowledge(seg, spans, "user_id").select("seg_id", F.coalesce("knowledge", F.lit(-1)).alias("knowledge"))


@query("occurrences_per_term", f"""WITH {TOKENS} SELECT token AS lemma, count(DISTINCT doc_id * 1000000 + ord) AS n_refs, min(doc_id * 1000000 + ord) AS first_ref FROM tok GROUP BY token""")
def occurrences_per_term(spark, sf_dir):
    t = tokens(spark, sf_dir).select(F.col("token").alias("lemma"), F.lit("").alias("reading"), F.col("doc_id").alias("ord"), F.col("ord").alias("start"))
    df = terms.occurrence_counts(terms.occurrences(t))
    return df.select("lemma", "n_refs", (F.col("first_ref.ord") * 1000000 + F.col("first_ref.start")).alias("first_ref"))


#: Words that begin with t stand for all words; pairs of them that occur three times or more are the dictionary.
@query("phrase_bigram_promotion", f"""WITH RECURSIVE {TOKENS}, t AS (SELECT doc_id, ord, token FROM tok WHERE token BETWEEN 't' AND 'u'),
    r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS start, token, count(*) OVER (PARTITION BY token) AS n FROM t),
    b AS (SELECT token || lead(token) OVER (PARTITION BY doc_id ORDER BY start) AS term FROM r), e AS (SELECT term, count(*) // 3 + 1 AS frequency FROM b WHERE term IS NOT NULL GROUP BY term HAVING count(*) >= 3),
    run AS (SELECT doc_id, start, 1 AS size, token AS form, n::DOUBLE AS product, n AS rarest FROM r
            UNION ALL SELECT run.doc_id, run.start, size + 1, form || token, product * n, least(rarest, n) FROM run JOIN r ON run.doc_id = r.doc_id AND r.start = run.start + size WHERE length(form) < (SELECT max(length(term)) FROM e)),
    g AS (SELECT doc_id, start, size, form, frequency FROM run JOIN e ON form = term WHERE size > 1 AND length(form) >= 4 AND (pow(frequency::DOUBLE, size) / product <= 10 OR frequency / rarest::DOUBLE >= 120) AND NOT (frequency > 10000 AND frequency / rarest::DOUBLE < 40))
    SELECT doc_id, start, max(size)::BIGINT AS size, arg_max(form, size) AS form, arg_max(frequency, size) AS frequency FROM g GROUP BY doc_id, start""")
def phrase_bigram_promotion(spark, sf_dir):
    t = tokens(spark, sf_dir).filter("token BETWEEN 't' AND 'u'")
    single = t.groupBy("token").agg(F.count("*").alias("freq"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    t = t.select("doc_id", place.alias("pos_in_sentence"), "token").join(single, "token")
    word = F.struct(F.col("token").alias("full"), F.lit("").alias("reading"), F.col("token").alias("lemma"), F.lit("").alias("lemma_reading"), F.lit("Verb").alias("pos"), F.col("freq"))
    words = t.select(F.col("doc_id").alias("sentence_id"), "pos_in_sentence", word.alias("word"))
    follow = F.lead("token").over(Window.partitionBy("doc_id").orderBy("pos_in_sentence"))
    pairs = t.select(F.concat("token", follow).alias("term")).filter("term IS NOT NULL").groupBy("term").agg(F.expr("count(*) div 3 + 1").alias("value"), F.count("*").alias("n")).filter("n >= 3")
    entries = pairs.select(F.lit("d").alias("dict"), "term", F.lit("").alias("reading"), "value", F.lit(False).alias("kana_marker"), F.lit(0).cast("long").alias("entry_ord"))
    df = terms.promote_phrases(words, staged(entries))
    return df.select(F.col("sentence_id").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"), "form", "frequency")


@query("conflict_groups", r"""SELECT key, count(*) AS n, min(id) AS first_item, max(id) AS last_item FROM (SELECT regexp_replace(regexp_extract(text, '^[^.!?]*'), '\s+', '', 'g') AS key, conv_id * 1000 + turn AS id FROM conversations) WHERE key <> '' GROUP BY key HAVING count(*) >= 2""")
def conflict_groups(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.regexp_extract("text", "^[^.!?]*", 0).alias("sentence"))
    return mining.conflict_groups(items, T.sentence_key(F.col("sentence"), tags=False))


@query("table_controls", f"""WITH {TOKENS}, c AS (SELECT token, min(lang) AS pos, count(*) AS n FROM tok GROUP BY token)
    SELECT token AS lemma, pos, n AS harmonic FROM c WHERE n BETWEEN 5 AND 500 AND pos <> 'es' AND (contains(token, 'th') OR contains(pos, 'th'))""")
def table_controls(spark, sf_dir):
    t = tokens(spark, sf_dir).groupBy(F.col("token").alias("lemma")).agg(F.min("lang").alias("pos"), F.count("*").alias("harmonic"))
    nothing = F.lit(None).cast("string")
    t = t.select("*", F.col("lemma").alias("term_id"), nothing.alias("lemma_reading"), nothing.alias("surface"), nothing.alias("surface_reading"), nothing.alias("full_segment"), nothing.alias("level"))
    state = controls.Controls(least=5, most=500, include_unknown=False, pos={"es": False}, query=" th ")
    return controls.apply(t, state).select("lemma", "pos", "harmonic")


@query("frequency_bounds", f"""WITH {TOKENS}, c AS (SELECT lang, token, count(*) AS n FROM tok GROUP BY lang, token) SELECT greatest(coalesce(min(n), 1), 1)::BIGINT AS least, greatest(coalesce(max(n), 1), 1)::BIGINT AS most FROM c""")
def frequency_bounds(spark, sf_dir):
    counts = tokens(spark, sf_dir).groupBy("lang", "token").agg(F.count("*").alias("harmonic"))
    return controls.frequency_bounds(counts).select(F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"))


@query("status_change_events", """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def status_change_events(spark, sf_dir):
    from termflow.streaming import events as E

    return E.changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("ack_correlation", f"""WITH e AS (SELECT event_id, user_id, event_type, {EVENT_SECONDS} AS s FROM events), a AS (SELECT min(event_type) AS lo, max(event_type) AS hi FROM events),
    r AS (SELECT user_id AS message_id, min(s) AS asked FROM e, a WHERE event_type = lo GROUP BY user_id), k AS (SELECT user_id AS message_id, min(s) AS acked FROM e, a WHERE event_type = hi GROUP BY user_id)
    SELECT r.message_id, CASE WHEN acked BETWEEN asked AND asked + 86400 THEN 'confirmed' ELSE 'expired' END AS status FROM r LEFT JOIN k ON r.message_id = k.message_id""")
def ack_correlation(spark, sf_dir):
    from termflow.streaming import events as E

    e = table(spark, sf_dir, "events").withColumn("s", F.expr("unix_seconds(cast(ts as timestamp))"))
    ends = e.agg(F.min("event_type"), F.max("event_type")).first()
    one = lambda kind, name: e.filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("message_id")).agg(F.min("s").alias(name))
    return E.correlate(one(ends[0], "at"), one(ends[1], "acked"), 86400).select("message_id", "status")


@query("eta_smoothing", """WITH o AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id) SELECT user_id, floor(list_reduce(v, lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * x) * 1000 + 0.5)::BIGINT AS eta_mille FROM o""")
def eta_smoothing(spark, sf_dir):
    from termflow.streaming import events as E

    df = E.smoothed(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return df.select("user_id", F.floor(F.col("smoothed") * 1000 + 0.5).alias("eta_mille"))


@query("recents_upsert", """SELECT path, last_opened_us FROM (SELECT 'user' || user_id AS path, max(epoch_us(ts::TIMESTAMP)) AS last_opened_us FROM events GROUP BY user_id) ORDER BY last_opened_us DESC, path LIMIT 50""")
def recents_upsert(spark, sf_dir):
    from termflow.sources import appdata

    events = table(spark, sf_dir, "events").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("path"), F.expr("unix_micros(cast(ts as timestamp))").alias("last_opened"))
    return appdata.recents(events).select("path", F.col("last_opened").alias("last_opened_us"))


@query("filename_media", """SELECT page_id, 'movie' AS kind, regexp_extract(url, '([0-9]+)', 1) AS title, 1990 + page_id % 30 AS year FROM pages WHERE regexp_matches(url, '[0-9]')""")
def filename_media(spark, sf_dir):
    name = F.concat(F.regexp_extract("url", "([0-9]+)", 1), F.lit(" ("), (1990 + F.col("page_id") % 30).cast("string"), F.lit(") [1080p].mkv"))
    df = table(spark, sf_dir, "pages").filter(F.col("url").rlike("[0-9]")).select("page_id", N.media(name).alias("m"))
    return df.select("page_id", "m.kind", "m.title", F.col("m.year").cast("long").alias("year"))


@query("folder_counts", """WITH s AS (SELECT string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS p FROM pages), f AS (SELECT array_to_string(p[1:k], '/') AS folder FROM (SELECT p, unnest(range(1, greatest(len(p) - 1, 1) + 1)) AS k FROM s)) SELECT folder, count(*) AS n FROM f GROUP BY folder""")
def folder_counts(spark, sf_dir):
    path = F.regexp_extract("url", "://([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(F.explode(N.prefixes(path)).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# these register their queries on import
from termflow.plans import extra as _extra  # noqa: E402, F401
from termflow.plans import more as _more  # noqa: E402, F401

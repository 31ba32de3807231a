"""Registered queries of names, labels, sinks and small tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from termflow.functions import naming as N
from termflow.functions import text as T
from termflow.operators import controls, corpus, frequency, mining, terms
from termflow.plans.registry import TOKENS, query, table, tokens
from termflow.sources import appdata, books, sinks
from termflow.streaming import events as E


@query("clean_cues", r"""SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) || '&x  <' AS text FROM conversations""")
def clean_cues(spark, sf_dir):
    raw = F.concat(F.lit("  <i>"), F.col("text"), F.lit("</i>(かな よみ)&amp;x\n{\\an8}  &lt; "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_subtitle(raw).alias("text"))


@query("script_tests", """WITH w AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'かな' || p_size WHEN 1 THEN 'かなー' WHEN 2 THEN 'カナ・ー' WHEN 3 THEN '漢字' WHEN 4 THEN '漢かな' ELSE 'ab' END AS word FROM part)
    SELECT p_partkey, word, regexp_full_match(word, '[ぁ-ゖゝゞァ-ヺー・ヽヾ]+') AS is_kana, regexp_full_match(word, '[぀-ヿ]*') AS all_kana, regexp_matches(word, '[㐀-䶿一-鿿々]') AS has_kanji, regexp_full_match(word, '[㐀-䶿一-鿿々]+') AS all_kanji,
        regexp_replace(word, '[^ぁ-ゖゝゞァ-ヺーヽヾ]', '', 'g') AS kept, CASE WHEN regexp_full_match(word, '[ァ-ヺー・]+') THEN 'トオリ' ELSE 'とうり' END AS reading FROM w""")
def script_tests(spark, sf_dir):
    k, w = F.col("p_partkey") % 6, F.col("word")
    word = F.when(k == 0, F.concat(F.lit("かな"), F.col("p_size").cast("string"))).when(k == 1, "かなー").when(k == 2, "カナ・ー").when(k == 3, "漢字").when(k == 4, "漢かな").otherwise("ab")
    df = table(spark, sf_dir, "part").select("p_partkey", word.alias("word"))
    return df.select("p_partkey", "word", T.is_kana(w).alias("is_kana"), T.is_all_kana(w).alias("all_kana"), T.has_kanji(w).alias("has_kanji"), T.all_kanji(w).alias("all_kanji"), T.keep_kana(w).alias("kept"), T.reading_key(w, F.lit("トオリ")).alias("reading"))


@query("media_names", """WITH n AS (SELECT p_partkey AS k, p_size AS s FROM part)
    SELECT k, CASE k % 4 WHEN 3 THEN 'movie' ELSE 'tv' END AS kind, CASE k % 4 WHEN 0 THEN 'My Show' WHEN 1 THEN 'Another Show' WHEN 2 THEN 'Third Show' ELSE 'Great Movie' END AS title, CASE WHEN k % 4 = 0 THEN 1 + s % 9 END::INT AS season,
        CASE WHEN k % 4 < 3 THEN 1 + s END::INT AS episode, CASE WHEN k % 4 = 3 THEN 1950 + s END::INT AS year, CASE WHEN k % 4 IN (0, 3) THEN 'Netflix' END AS source,
        CASE k % 4 WHEN 0 THEN printf('My Show - S%02dE%02d', (1 + s % 9)::INT, (1 + s)::INT) WHEN 1 THEN 'Another Show - Episode ' || (1 + s) WHEN 2 THEN 'Third Show - Episode ' || (1 + s) ELSE 'Great Movie (' || (1950 + s) || ')' END AS shown, k % 4 IN (0, 3) AS matchable FROM n""")
def media_names(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("int")
    name = (
        F.when(k % 4 == 0, F.format_string("my.show.S%02dE%02d.Netflix.ja.srt", 1 + s % 9, 1 + s)).when(k % 4 == 1, F.format_string("[Group] Another Show episode %d.mkv", 1 + s))
        .when(k % 4 == 2, F.format_string("Third Show %02d.srt", 1 + s)).otherwise(F.format_string("GREAT_MOVIE (%d) [Netflix].mkv", 1950 + s))
    )
    df = table(spark, sf_dir, "part").select(k.alias("k"), N.media(name).alias("m"))
    return df.select("k", "m.kind", "m.title", "m.season", "m.episode", "m.year", "m.source", N.display_title(F.col("m")).alias("shown"), N.matchable(F.col("m")).alias("matchable"))


@query("recents_labels", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Unknown' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%.1f MB', n / 1048576.0::DOUBLE) END AS size,
        CASE WHEN o_orderkey % 7 = 0 THEN 'Unknown terms' WHEN o_orderkey % 7 = 1 THEN '1 term' ELSE o_orderkey % 7 || ' terms' END AS terms, 'a_b_' || o_orderkey || '_' AS stem FROM (SELECT o_orderkey, (floor(o_totalprice)::BIGINT * (o_orderkey % 40)) AS n FROM orders)""")
def recents_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    n = F.when(k % 5 != 0, F.floor("o_totalprice") * (k % 40))
    count = F.when(k % 7 != 0, k % 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", N.size_label(n).alias("size"), N.terms_label(count).alias("terms"), N.safe_stem(F.concat(F.lit(' a/b:'), k.cast("string"), F.lit("? "))).alias("stem"))


@query("stamp_labels", """SELECT o_orderkey, (ms % 86400000) / 1000.0::DOUBLE AS seconds, rpad(CASE WHEN ms % 86400000 >= 3600000 THEN (ms % 86400000) // 3600000 || 'h ' || (ms % 86400000) // 60000 % 60 || 'm ' || (ms % 86400000) // 1000 % 60 || 's'
        WHEN ms % 86400000 >= 60000 THEN (ms % 86400000) // 60000 % 60 || 'm ' || (ms % 86400000) // 1000 % 60 || 's' ELSE (ms % 86400000) // 1000 || 's' END, 11, ' ') AS label FROM (SELECT o_orderkey, o_orderkey * 7919 AS ms FROM orders)""")
def stamp_labels(spark, sf_dir):
    ms = F.col("o_orderkey") * 7919
    return table(spark, sf_dir, "orders").select("o_orderkey", T.seconds(ms).alias("seconds"), N.human_time(ms).alias("label"))


@query("file_tree", """WITH p AS (SELECT DISTINCT c_mktsegment || '/' || c_nationkey || '/' || c_custkey || '.srt' AS tail FROM customer), s AS (SELECT '/data/all/' || tail AS path, string_split(tail, '/') AS p FROM p),
    k AS (SELECT path, p, unnest(range(1, len(p) + 1)) AS depth FROM s)
    SELECT depth::INT AS depth, array_to_string(p[:depth], '/') AS prefix, array_to_string(p[:depth - 1], '/') AS parent, p[depth] AS name, CASE WHEN depth = len(p) THEN path END AS path, count(*) AS n_files FROM k GROUP BY ALL""")
def file_tree(spark, sf_dir):
    path = F.concat_ws("/", F.lit("/data/all"), "c_mktsegment", F.col("c_nationkey").cast("string"), F.concat(F.col("c_custkey").cast("string"), F.lit(".srt")))
    return N.file_tree(table(spark, sf_dir, "customer").select(path.alias("path")))


@query("source_files", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'EPUB' ELSE 'SRT' END AS file_type, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 2 THEN 'Book ' || p_size ELSE 'Book ' || p_size || ' Part' END AS title,
        '/x/book_' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.epub' ELSE '_part.srt' END AS original_file, CASE WHEN p_partkey % 2 = 0 THEN 'chapter ' || p_size END AS label FROM part""")
def source_files(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.concat(F.lit("/x/book_"), F.col("p_size").cast("string"), F.when(k % 2 == 0, ".epub").otherwise("_part.srt"))
    title = F.when(k % 4 == 0, F.col("p_name")).otherwise("")
    df = table(spark, sf_dir, "part").select("p_partkey", N.source_file(path, title, F.concat(F.lit(" chapter "), F.col("p_size").cast("string"), F.lit(" "))).alias("f"))
    return df.select("p_partkey", "f.file_type", "f.title", "f.original_file", "f.label")


@query("cloze_parts", """SELECT c_custkey, c_name[:strpos(c_name, '0') - 1] AS prefix, CASE WHEN strpos(c_name, '0') > 0 THEN '0' ELSE '' END AS body, c_name[strpos(c_name, '0') + 1:] AS suffix FROM customer WHERE strpos(c_name, '0') > 0
    UNION ALL SELECT c_custkey, c_name, '', '' FROM customer WHERE strpos(c_name, '0') = 0""")
def cloze_parts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.cloze(F.col("c_name"), F.lit("0")).alias("c")).select("c_custkey", "c.*")


@query("byte_slices", """SELECT c_custkey, c_name[3:] AS tail FROM customer""")
def byte_slices(spark, sf_dir):
    text = F.concat(F.lit("犬é"), F.col("c_name"))  # five bytes before the name
    return table(spark, sf_dir, "customer").select("c_custkey", T.byte_slice(text, F.lit(7), F.octet_length(text)).alias("tail"))


@query("subtitle_blocks", """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_id % 10 = 0)
    SELECT 'u' || user_id AS path, event_id AS ord, n || chr(10) || printf('%02d:%02d:%02d,%03d', (n * 5000) // 3600000 % 24, (n * 5000) // 60000 % 60, (n * 5000) // 1000 % 60, 0) || ' --> ' || printf('%02d:%02d:%02d,%03d', (n * 5000 + 1500) // 3600000 % 24, (n * 5000 + 1500) // 60000 % 60, (n * 5000 + 1500) // 1000 % 60, 500) || chr(10) || 'line ' || event_id || chr(10) AS block FROM e""")
def subtitle_blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_id % 10 = 0")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    cues = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("ord"), F.concat(F.lit("line "), F.col("event_id").cast("string")).alias("text"), (n * 5000).cast("long").alias("start_ms"), (n * 5000 + 1500).cast("long").alias("end_ms"))
    return sinks.srt_blocks(cues)


@query("rank_list_lines", f"""WITH {TOKENS}, c AS (SELECT token, lang, count(*) AS n FROM tok WHERE token < 'b' GROUP BY token, lang)
    SELECT rank() OVER (ORDER BY n DESC) || ',"' || token || '","' || coalesce(lang, '') || '",' || n AS line FROM c UNION ALL SELECT 'Rank,Term,Reading,Frequency'""")
def rank_list_lines(spark, sf_dir):
    counts = tokens(spark, sf_dir).filter("token < 'b'").groupBy(F.col("token").alias("lemma"), F.col("lang").alias("reading")).agg(F.count("*").alias("n"))
    return sinks.frequency_lines(counts).select("line")


@query("dictionary_entries", f"""WITH {TOKENS}, c AS (SELECT token, lang, count(*) AS n FROM tok WHERE token < 'b' GROUP BY token, lang HAVING count(*) > 1), r AS (SELECT *, rank() OVER (ORDER BY n DESC) AS rank FROM c)
    SELECT token AS lemma, rank, '["' || token || '","freq",' || CASE WHEN lang IS NULL THEN rank::VARCHAR ELSE '{{"reading":"' || lang || '","frequency":' || rank || '}}' END || ']' AS row FROM r""")
def dictionary_entries(spark, sf_dir):
    counts = tokens(spark, sf_dir).filter("token < 'b'").groupBy(F.col("token").alias("lemma"), F.col("lang").alias("reading")).agg(F.count("*").alias("n"))
    return sinks.dictionary_rows(counts, drop_hapax=True).select("lemma", "rank", "row")


@query("folded_lookup", """WITH w AS (SELECT p_partkey AS word_id, CASE WHEN p_partkey % 3 = 0 THEN 'ケガ' ELSE 'けが' END || p_size AS word FROM part),
    f AS (SELECT DISTINCT 'けが' || p_size AS term, min(p_partkey) OVER (PARTITION BY p_size) AS value FROM part WHERE p_size % 2 = 0), g AS (SELECT DISTINCT 'ケガ' || p_size AS term, 7 AS value FROM part WHERE p_size % 5 = 0)
    SELECT word_id, 'd' AS dict, coalesce(g.value, f.value)::BIGINT AS value FROM w LEFT JOIN g ON word = g.term LEFT JOIN f ON replace(word, 'ケガ', 'けが') = f.term WHERE g.value IS NOT NULL OR f.value IS NOT NULL""")
def folded_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    none = F.lit(None).cast("string")
    row = lambda term, value: [F.lit("d").alias("dict"), term.alias("term"), none.alias("reading"), value.cast("long").alias("value"), F.lit(False).alias("kana_marker"), F.lit(0).cast("long").alias("entry_ord")]
    soft = part.filter("p_size % 2 = 0").groupBy("p_size").agg(F.min("p_partkey").alias("v")).select(*row(F.concat(F.lit("けが"), size), F.col("v")))
    hard = part.filter("p_size % 5 = 0").select("p_size").distinct().select(*row(F.concat(F.lit("ケガ"), size), F.lit(7)))
    words = part.select(F.col("p_partkey").alias("word_id"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "ケガ").otherwise("けが"), size).alias("word"), F.lit("x").alias("reading"), F.lit(False).alias("is_kana"))
    return frequency.lookup_folded(words, soft.unionByName(hard))


@query("harvested_notes", """SELECT c_custkey AS note_id, c_name AS term, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'とうい' END AS reading, replace(c_mktsegment || c_custkey, ' ', '') AS sentence FROM customer WHERE c_custkey % 4 < 3""")
def harvested_notes(spark, sf_dir):
    k = F.col("c_custkey")
    fields = F.create_map(F.lit("Word"), F.concat(F.lit("  "), F.col("c_name")), F.lit("Reading"), F.when(k % 3 != 0, "[とおい] x").otherwise("-"), F.lit("Sentence"), F.concat(F.lit("<b>"), F.col("c_mktsegment"), F.lit("</b> "), k.cast("string")))
    notes = table(spark, sf_dir, "customer").select(k.alias("note_id"), F.when(k % 4 < 3, "m").otherwise("other").alias("model"), fields.alias("fields"))
    mapping = spark.createDataFrame([("m", "Word", "Reading", "Sentence")], "model string, term_field string, reading_field string, sentence_field string")
    return mining.harvest(notes, mapping)


@query("recent_notes", """SELECT event_id AS note_id, event_type AS term, 'user' || user_id AS sentence FROM events WHERE ts::TIMESTAMP >= (SELECT max(ts::TIMESTAMP) FROM events) - INTERVAL 1 DAY""")
def recent_notes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("added", F.col("ts").cast("timestamp"))
    last = e.agg(F.max("added")).first()[0]
    fields = F.create_map(F.lit("Word"), F.concat(F.lit("<b> "), F.col("event_type")), F.lit("Sentence"), F.concat(F.lit("user "), F.col("user_id").cast("string")))
    notes = e.select(F.col("event_id").alias("note_id"), F.lit("m").alias("model"), fields.alias("fields"), "added")
    mapping = spark.createDataFrame([("m", "Word", "Reading", "Sentence")], "model string, term_field string, reading_field string, sentence_field string")
    return mining.recently_added(notes, mapping, F.lit(last))


@query("mined_sentence_set", """SELECT c_mktsegment AS sentence FROM customer UNION SELECT s_name FROM supplier""")
def mined_sentence_set(spark, sf_dir):
    return mining.mined_sentences(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("sentence")), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("sentence")))


@query("filled_cards", """SELECT p_partkey AS note_id, 'm' AS model, 'deck' AS deck, p_name || ' (' || p_brand || ')' AS front, CASE WHEN p_size % 2 = 0 THEN p_type END AS back FROM part""")
def filled_cards(spark, sf_dir):
    values = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" "))
    notes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("note_id"), F.lit("m").alias("model"), values.alias("values"))
    formats = spark.createDataFrame([("m", "deck", {"front": "{name} ({brand})", "back": "{type}"})], "model string, deck string, templates map<string,string>")
    return mining.assemble(notes, formats).select("note_id", "model", "deck", F.element_at("fields", "front").alias("front"), F.element_at("fields", "back").alias("back"))


@query("table_sorted_top", f"""WITH {TOKENS}, c AS (SELECT token, CASE WHEN count(*) > 3 THEN count(*) END AS n FROM tok WHERE token < 'b' GROUP BY token) SELECT token AS lemma, n AS harmonic FROM c ORDER BY n DESC NULLS FIRST, token LIMIT 300""")
def table_sorted_top(spark, sf_dir):
    t = tokens(spark, sf_dir).filter("token < 'b'").groupBy(F.col("token").alias("lemma")).agg(F.count("*").alias("n"))
    t = t.select("lemma", F.when(F.col("n") > 3, F.col("n")).alias("harmonic"), F.col("lemma").alias("term_id"))
    return controls.ordered(t, controls.Controls(sort="frequency", descending=True)).limit(300).select("lemma", "harmonic")  # an order shows in its first rows


@query("first_of_terms", f"""WITH {TOKENS}, t AS (SELECT token AS lemma, lang AS lemma_reading, doc_id * 100000 + ord AS ord FROM tok WHERE token < 'c') SELECT lemma, lemma_reading, min(ord) AS ord FROM t GROUP BY lemma, lemma_reading""")
def first_of_terms(spark, sf_dir):
    t = tokens(spark, sf_dir).filter("token < 'c'").select(F.col("token").alias("lemma"), F.col("lang").alias("lemma_reading"), (F.col("doc_id") * 100000 + F.col("ord")).alias("ord"))
    return terms.unique_terms(t)


@query("display_texts", """WITH s AS (SELECT l_orderkey AS k, l_linenumber * 10 AS a, l_linenumber * 10 + 10 AS b, 's' || l_linenumber AS surface FROM lineitem), o AS (SELECT o_orderkey AS k, 15 AS a, 15 + (o_orderkey % 30) AS b FROM orders)
    SELECT o.k AS occ_id, coalesce(string_agg(surface, '' ORDER BY s.a), '') AS text FROM o LEFT JOIN s ON o.k = s.k AND s.a < o.b AND s.b > o.a GROUP BY o.k""")
def display_texts(spark, sf_dir):
    n = F.col("l_linenumber")
    seg = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sentence_id"), (n * 10).alias("seg_start"), (n * 10 + 10).alias("seg_end"), F.concat(F.lit("s"), n.cast("string")).alias("surface"))
    occ = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("occ_id"), F.col("o_orderkey").alias("sentence_id"), F.lit(15).alias("start"), (15 + F.col("o_orderkey") % 30).alias("end"))
    return terms.display_text(occ, seg).select("occ_id", "text")


@query("chapters_seen", """SELECT o_orderkey AS part, o_custkey::VARCHAR AS path, o_orderkey % 3 = 0 AS seen FROM orders""")
def chapters_seen(spark, sf_dir):
    parts = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("part"))
    history = appdata.read_parts(spark.createDataFrame([], "path string, parts array<bigint>"), parts.filter("part % 3 = 0"))
    return appdata.chapters_seen(parts, history)


@query("book_parts", """SELECT o_custkey::VARCHAR AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) - 1 AS part_id, o_orderstatus AS chapter, sum(length(o_orderpriority))::BIGINT AS chars FROM orders GROUP BY o_custkey, o_orderstatus""")
def book_parts(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderstatus").alias("chapter"), F.lit("t").alias("chapter_title"), F.lit(0).alias("part"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("line"))
    return books.list_parts(lines).select("path", F.col("part_id").cast("long").alias("part_id"), "chapter", "chars")


@query("chosen_parts", """WITH p AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) - 1 AS part_id FROM orders GROUP BY o_custkey, o_orderstatus)
    SELECT o_orderkey AS ord, o.o_custkey::VARCHAR AS path FROM orders o JOIN p ON o.o_custkey = p.o_custkey AND o.o_orderstatus = p.o_orderstatus WHERE part_id = 1""")
def chosen_parts(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderstatus").alias("chapter"), F.lit("t").alias("chapter_title"), F.lit(0).alias("part"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("line"))
    return books.select_parts(lines, [1, 99]).select("ord", "path")


@query("ignore_changes", """SELECT origin, enabled, count(DISTINCT term) AS n_terms FROM (SELECT n_name AS term, 'file' AS origin, n_nationkey % 2 = 0 AS enabled FROM nation UNION ALL SELECT x, 'manual', true FROM (VALUES ('の'), ('は'), ('new')) v(x)) GROUP BY origin, enabled""")
def ignore_changes(spark, sf_dir):
    files = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.lit("file").alias("origin"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))
    df = appdata.set_ignored(files, ["の", "は", "の", "gone"])
    return appdata.ignore_view(appdata.remove_ignored(appdata.add_ignored(appdata.add_ignored(df, "new"), "の"), "gone"))


@query("confirmed_jumps", """SELECT event_id::DOUBLE AS timestamp, CASE WHEN event_id % 2 = 0 THEN 'websocket' ELSE 'mpv' END AS source FROM events WHERE event_id % 5 < 3""")
def confirmed_jumps(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_id % 5 < 3").select("event_id", F.col("event_id").cast("double").alias("timestamp"))
    return E.confirmed_timestamps(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"))


@query("confirmation_log", """SELECT event_id AS message_id, event_id * 3 AS acked FROM events ORDER BY event_id * 3 DESC LIMIT 50""")
def confirmation_log(spark, sf_dir):
    return E.trimmed_log(table(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), (F.col("event_id") * 3).alias("acked")))


@query("player_choice", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'mpv' WHEN event_id % 3 = 0 THEN 'websocket' ELSE 'none' END AS player FROM events""")
def player_choice(spark, sf_dir):
    k = F.col("event_id")
    return E.arbitrated(table(spark, sf_dir, "events").select("event_id", (k % 2 == 0).alias("mpv"), (k % 3 == 0).alias("websocket"))).select("event_id", "player")


@query("seek_status", """WITH s AS (SELECT user_id, event_id, event_id * 100 AS at, (event_id % 50)::DOUBLE AS target FROM events WHERE event_id % 7 = 0), p AS (SELECT user_id, event_id * 100 + 40 AS at, (event_id % 50)::DOUBLE + CASE WHEN event_id % 2 = 0 THEN 0.005::DOUBLE ELSE 0.5::DOUBLE END AS position FROM events)
    SELECT s.event_id, CASE WHEN bool_or(p.at IS NOT NULL) THEN 'confirmed' ELSE 'timeout' END AS status FROM s LEFT JOIN p ON s.user_id = p.user_id AND p.at BETWEEN s.at AND s.at + 3000 AND abs(position - target) <= 0.01 GROUP BY s.event_id""")
def seek_status(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session"))
    seeks = e.filter(k % 7 == 0).select("event_id", "session", (k * 100).alias("at"), (k % 50).cast("double").alias("target"))
    positions = e.select("session", (k * 100 + 40).alias("at"), ((k % 50).cast("double") + F.when(k % 2 == 0, 0.005).otherwise(0.5)).alias("position"))
    return E.confirmed_seeks(seeks, positions).select("event_id", "status")


@query("appended_sentences", """SELECT c_mktsegment AS text FROM customer UNION ALL SELECT DISTINCT p_type FROM part WHERE p_type NOT IN (SELECT c_mktsegment FROM customer)""")
def appended_sentences(spark, sf_dir):
    have = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("text"))
    part = table(spark, sf_dir, "part")
    fetched = part.select(F.col("p_type").alias("text")).unionByName(have).unionByName(part.select(F.lit(" ").alias("text")))
    return corpus.append_new(have, fetched)

"""Further registered queries: one operator each, over the given tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from termflow.functions import japanese as J
from termflow.functions import naming as N
from termflow.functions import text as T
from termflow.operators import corpus, frequency, mining, summary, terms, vocabulary
from termflow.plans.registry import EVENT_SECONDS, SENTENCES, TOKENS, query, sentences, table, tokens
from termflow.sources import appdata, books, subtitles
from termflow.streaming import events as E


@query("file_types", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'SRT' WHEN p_size % 5 = 1 THEN 'SSA' WHEN p_size % 5 = 2 THEN 'TXT' WHEN p_size % 5 = 3 THEN 'PDF' ELSE '' END AS type FROM part""")
def file_types(spark, sf_dir):
    ext = F.get(F.array(*map(F.lit, [".srt", ".ASS", ".Txt", ".pdf", ""])), F.col("p_size") % 5)
    return table(spark, sf_dir, "part").select("p_partkey", N.file_type(F.concat(F.lit("/d/f"), ext)).alias("type"))


@query("cue_times", f"""SELECT event_id, printf('%02d:%02d:%02d,%03d', (s * 1000 % 86400000) // 3600000, (s * 1000 % 86400000) // 60000 % 60, s % 60, 0) AS stamp, ((s % 86400) * 1000)::BIGINT AS ms FROM (SELECT event_id, {EVENT_SECONDS} AS s FROM events)""")
def cue_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.expr("unix_seconds(cast(ts as timestamp))") * 1000).alias("t"))
    return e.select("event_id", T.clock(F.col("t")).alias("stamp"), T.milliseconds(T.clock(F.col("t"))).alias("ms"))


@query("filtered_sentences_renumbered", rf"""WITH {SENTENCES}, f AS (SELECT doc_id, line, part, trim(regexp_replace(text, '[A-Z][a-z]+', '', 'g')) AS text FROM sent)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, part) - 1 AS ord, text FROM f WHERE text <> ''""")
def filtered_sentences_renumbered(spark, sf_dir):
    df = sentences(spark, sf_dir).withColumn("text", T.apply_filters(F.col("text"), [("[A-Z][a-z]+", "")])).filter("text <> ''")
    return subtitles.numbered(df.withColumnRenamed("doc_id", "path"), ["line", "part"]).select(F.col("path").alias("doc_id"), F.col("ord").cast("long").alias("ord"), "text")


@query("search_in_sentences", rf"""WITH {SENTENCES}, t AS (SELECT DISTINCT doc_id FROM sent WHERE contains(lower(text), 'erth')) SELECT d.doc_id, lang FROM documents d JOIN t ON d.doc_id = t.doc_id""")
def search_in_sentences(spark, sf_dir):
    hit = sentences(spark, sf_dir).filter(T.text_matches(F.col("text"), F.lit("erth"))).select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(hit, "doc_id", "left_semi")


@query("trimmed_mean_sizes", """WITH s AS (SELECT o_custkey AS source, count(*) AS size FROM orders GROUP BY o_custkey), r AS (SELECT size, row_number() OVER (ORDER BY size, source) AS nth, count(*) OVER () AS n FROM s)
    SELECT (sum(size) // count(*))::BIGINT AS target FROM r WHERE nth > n // 20 AND nth <= n - n // 20""")
def trimmed_mean_sizes(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").alias("size"))
    return corpus.trimmed_mean(sizes)


@query("lemma_merge", f"""WITH {TOKENS}, c AS (SELECT token AS surface, lang AS reading, count(*) AS n FROM tok GROUP BY token, lang)
    SELECT CASE WHEN length(surface) > 4 THEN surface[:4] ELSE surface END AS lemma, reading, sum(n)::BIGINT AS n FROM c GROUP BY 1, 2""")
def lemma_merge(spark, sf_dir):
    counts = tokens(spark, sf_dir).groupBy(F.col("token").alias("surface"), F.col("lang").alias("reading")).agg(F.count("*").alias("n"))
    lemmas = counts.filter(F.length("surface") > 4).select("surface", "reading", F.substring("surface", 1, 4).alias("lemma"), F.col("reading").alias("lemma_reading"))
    return corpus.merge_lemmas(counts, lemmas)


@query("consecutive_dedupe", """SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def consecutive_dedupe(spark, sf_dir):
    return E.changes(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type").select("event_id")


@query("reading_confidence", """WITH m AS (SELECT p_brand AS word, p_type AS reading, avg(p_size) AS v FROM part GROUP BY 1, 2), s AS (SELECT *, min(v) OVER (PARTITION BY word) AS lo, max(v) OVER (PARTITION BY word) AS hi FROM m)
    SELECT word, reading, floor(CASE WHEN hi > lo THEN 1 - (0.1::DOUBLE + 0.8::DOUBLE * (v - lo) / (hi - lo)) ELSE 0.9::DOUBLE END * 10000 + 0.5)::BIGINT AS parts FROM s""")
def reading_confidence(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"), F.col("p_type").alias("reading"), F.col("p_size").alias("value"), F.lit(False).alias("kana_marker"))
    df = vocabulary.pair_confidence(entries).select("word", F.explode("readings").alias("reading", "c"))
    return df.select("word", "reading", F.floor(F.col("c") * 10000 + 0.5).alias("parts"))


@query("catalog_status", """SELECT n_name AS title, CASE WHEN s.k IS NULL THEN 'missing' WHEN n_nationkey % 5 = 0 THEN 'unknown' WHEN n_nationkey % 3 = s.k % 3 THEN 'installed' ELSE 'outdated' END AS status
    FROM nation LEFT JOIN (SELECT s_nationkey AS k FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY s_nationkey) s ON s.k = n_nationkey""")
def catalog_status(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    catalog = nation.select(F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 5 != 0, (F.col("n_nationkey") % 3).cast("string")).alias("revision"))
    have = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("n_nationkey")).distinct().join(nation, "n_nationkey")
    return appdata.catalog_status(catalog, have.select(F.col("n_name").alias("title"), (F.col("n_nationkey") % 3).cast("string").alias("revision")))


@query("weight_settings", """SELECT n_name AS dict, greatest(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 50.0::DOUBLE ELSE 1.0::DOUBLE END, 0.1::DOUBLE)::DOUBLE AS weight, n_nationkey % 2 = 1 OR n_nationkey % 4 = 0 AS enabled FROM nation""")
def weight_settings(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    state = nation.select(F.col("n_name").alias("dict"), F.lit(1.0).alias("weight"), F.lit(True).alias("enabled"))
    new = nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("dict"), (F.col("n_nationkey") / 50.0).alias("weight"), (F.col("n_nationkey") % 4 == 0).alias("enabled"))
    return frequency.apply_weights(state, new)


@query("mined_flags", """SELECT l_orderkey, l_linenumber, l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) OR l_suppkey IN (SELECT p_partkey FROM part WHERE p_size < 10) AS mined FROM lineitem""")
def mined_flags(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("lemma"), F.col("l_suppkey").alias("surface"))
    return mining.with_mined(items, table(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("term"))).select("l_orderkey", "l_linenumber", "mined")


@query("mined_pruned", """SELECT c_custkey AS note_id, c_name AS sentence FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def mined_pruned(spark, sf_dir):
    mined = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("note_id"), F.col("c_name").alias("sentence"))
    return mining.prune_mined(mined, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("note_id")))


@query("mined_recorded", """SELECT s_suppkey AS note_id, min(s_name) AS sentence FROM supplier GROUP BY s_suppkey UNION ALL SELECT c_custkey, regexp_replace(c_name, '\\s+', '', 'g') FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def mined_recorded(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("note_id"), F.col("s_name").alias("sentence"))
    return mining.record_mined(old, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("note_id"), F.col("c_name").alias("sentence")))


@query("intervals_in_days", """SELECT o_orderkey AS card_id, floor(CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100000) / 86400.0::DOUBLE ELSE o_orderkey % 400 END * 1000 + 0.5)::BIGINT AS days_mille FROM orders""")
def intervals_in_days(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    cards = orders.select(F.col("o_orderkey").alias("card_id"), F.when(F.col("o_orderkey") % 3 == 0, -(F.col("o_orderkey") % 100000)).otherwise(F.col("o_orderkey") % 400).alias("interval"))
    df = mining.with_intervals(orders.select(F.col("o_orderkey").alias("card_id"), F.lit(None).cast("double").alias("interval")), cards)
    return df.select("card_id", F.floor(F.col("interval") * 1000 + 0.5).alias("days_mille"))


@query("conflict_keepers", r"""SELECT key, arg_min(id, (id % 7, id)) AS item_id FROM (SELECT regexp_replace(regexp_extract(text, '^[^.!?]*'), '\s+', '', 'g') AS key, conv_id * 1000 + turn AS id FROM conversations) WHERE key <> '' GROUP BY key""")
def conflict_keepers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.regexp_extract("text", "^[^.!?]*", 0).alias("sentence"))
    return mining.keepers(c.withColumns({"ts": F.col("item_id") % 7, "picked": F.lit(False)})).select("key", "item_id")


@query("batch_counters", """SELECT count(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 END) AS created, count(CASE WHEN event_type = (SELECT max(event_type) FROM events) THEN 1 END) AS duplicate, 0::BIGINT AS media_missing,
    count(CASE WHEN event_type NOT IN ((SELECT min(event_type) FROM events), (SELECT max(event_type) FROM events)) THEN 1 END) AS failed FROM events""")
def batch_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    low, high = e.agg(F.min("event_type"), F.max("event_type")).first()
    return mining.batch_result(e.select(F.when(F.col("event_type") == low, "created").when(F.col("event_type") == high, "duplicate").otherwise("failed").alias("status")))


@query("covering_term", f"""WITH e AS (SELECT event_id, user_id, event_type, {EVENT_SECONDS} AS s FROM events), a AS (SELECT min(event_type) AS lo, max(event_type) AS hi FROM events)
    SELECT x.event_id AS seg_id, coalesce(min(y.event_id), -1)::BIGINT AS term_id FROM (SELECT e.* FROM e, a WHERE event_type = lo) x LEFT JOIN (SELECT e.* FROM e, a WHERE event_type = hi) y ON x.user_id = y.user_id AND y.s < x.s + 600 AND y.s + 3600 > x.s GROUP BY x.event_id""")
def covering_term(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("unix_seconds(cast(ts as timestamp))").alias("s"))
    low, high = e.agg(F.min("event_type"), F.max("event_type")).first()
    seg = e.filter(F.col("event_type") == low).select("user_id", F.col("event_id").alias("seg_id"), F.col("s").alias("seg_start"), (F.col("s") + 600).alias("seg_end"))
    spans = e.filter(F.col("event_type") == high).select("user_id", F.col("s").alias("start"), (F.col("s") + 3600).alias("end"), F.col("event_id").alias("term_id"), F.col("event_id").alias("term_ord"))
    return terms.covering_term(seg, spans, "user_id").select("seg_id", F.coalesce("term_id", F.lit(-1)).alias("term_id"))


@query("chapters_by_contents", """WITH s AS (SELECT o_custkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderstatus = 'F' AS entry FROM orders),
    c AS (SELECT path, pos, CASE WHEN bool_or(entry) OVER (PARTITION BY path) THEN last_value(CASE WHEN entry THEN pos END IGNORE NULLS) OVER (PARTITION BY path ORDER BY pos) ELSE pos END AS chapter FROM s)
    SELECT path::VARCHAR AS path, chapter::BIGINT AS chapter, count(*) AS n_files FROM c WHERE chapter IS NOT NULL GROUP BY path, chapter""")
def chapters_by_contents(spark, sf_dir):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    spine = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), pos.alias("spine_pos"), (F.col("o_orderstatus") == "F").alias("entry"))
    spine = spine.select("path", "spine_pos", F.when(F.col("entry"), F.col("spine_pos")).alias("toc_pos"), F.when(F.col("entry"), "x").alias("toc_label"))
    return books.assign_chapters(spine).groupBy("path", F.col("chapter").cast("long").alias("chapter")).agg(F.count("*").alias("n_files"))


@query("parts_read", """SELECT o_custkey::VARCHAR AS path, count(DISTINCT o_orderkey % 12) AS n_parts, min(o_orderkey % 12) AS first_part FROM orders GROUP BY o_custkey""")
def parts_read(spark, sf_dir):
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), (F.col("o_orderkey") % 12).alias("part"))
    history = new.filter("part = 0").groupBy("path").agg(F.collect_set("part").alias("parts"))
    df = appdata.read_parts(history, new)
    return df.select("path", F.size("parts").cast("long").alias("n_parts"), F.array_min("parts").alias("first_part"))


@query("active_sets_changed", """WITH n AS (SELECT user_id AS session, event_id // 200 AS tick, array_to_string(list_sort(list_distinct(list(CASE WHEN value > 50 THEN event_type END))), ',') AS active FROM events GROUP BY 1, 2)
    SELECT session, tick, active FROM (SELECT *, lag(active) OVER (PARTITION BY session ORDER BY tick) AS before FROM n) WHERE before IS NULL OR before <> active""")
def active_sets_changed(spark, sf_dir):
    m = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.expr("event_id div 200").alias("tick"), F.col("event_type").alias("media_id"), (F.col("value") > 50).alias("active"))
    return E.active_media(m).select("session", "tick", F.array_join("active", ",").alias("active"))


@query("comprehension_bars", """SELECT l_orderkey, l_linenumber, least(ceil(l_discount * 10 * 5), 5)::INT AS bars FROM lineitem""")
def comprehension_bars(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.filled_bars(F.col("l_discount") * 10).alias("bars"))


@query("template_fields", """SELECT c_custkey, replace(replace('{name} of {segment}: ', '{name}', c_name), '{segment}', c_mktsegment) AS front FROM customer""")
def template_fields(spark, sf_dir):
    values = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", N.fill(F.lit("{name} of {segment}: {none}"), values).alias("front"))


@query("version_order", """SELECT p_partkey, p_size > 25 OR p_size = 25 AND p_partkey % 10 > 4 AS newer FROM part""")
def version_order(spark, sf_dir):
    v = F.concat_ws(".", F.lit("1"), F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", N.is_newer(v, F.lit("1.25.4")).alias("newer"))


@query("excluded_signs", "SELECT token, " + "trim(token) = '' OR NOT regexp_full_match(token, '[぀-ヿ㐀-䶿一-鿿々ｦ-ﾟ０-９Ａ-Ｚａ-ｚ！-／：-＠［-｀｛-･　-〿]+') OR token IN (SELECT sign FROM (VALUES " + ", ".join(f"('{s.replace(chr(39), chr(39) * 2)}')" for s in corpus.PUNCTUATION) + ") x(sign)) AS excluded FROM (VALUES " + ", ".join(f"('{s.replace(chr(39), chr(39) * 2)}')" for s in [*corpus.PUNCTUATION, "", " ", "abc", "犬", "いぬ", "イヌー", "ＡＢ", "犬x", "々"]) + ") y(token)")
def excluded_signs(spark, sf_dir):
    words = [*corpus.PUNCTUATION, "", " ", "abc", "犬", "いぬ", "イヌー", "ＡＢ", "犬x", "々"]
    return spark.createDataFrame([(w,) for w in words], "token string").select("token", corpus.excluded_token(F.col("token")).alias("excluded"))


@query("default_ignored", "SELECT term, 'manual' AS origin, true AS enabled, c_mktsegment AS segment FROM (VALUES ('の'), ('は'), ('に'), ('へ'), ('を'), ('て'), ('が'), ('だ'), ('た'), ('と'), ('から'), ('も'), ('で'), ('か'), ('です'), ('ね'), ('な'), ('ん'), ('し'), ('お')) t(term), (SELECT DISTINCT c_mktsegment FROM customer) c")
def default_ignored(spark, sf_dir):
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    ignored = appdata.ignore_list(spark, f"{sf_dir}/no_such_list.json")
    return segments.select("segment", F.explode(F.array(*[F.lit(r["term"]) for r in ignored.collect()])).alias("term")).join(ignored, "term").select("term", "origin", "enabled", "segment")  # the list has twenty


def _number_sql(digits: str) -> str:
    """Reading of a column of digits without leading zeros."""
    pick = lambda values, at: f"[{', '.join(repr(v) for v in values)}][1 + {at}]"
    irregular = lambda own, unit: [own.get(d, J.DIGITS[d] + unit) if d else "" for d in range(10)]
    places = [J.DIGITS, ["", "ジュウ", *[d + "ジュウ" for d in J.DIGITS[2:]]], irregular(J.HUNDREDS, "ヒャク"), irregular(J.THOUSANDS, "セン")]
    digit = lambda i: f"substr(lpad({digits}, 16, '0'), {16 - i}, 1)::INT"
    groups = [" || ".join(pick(places[p], digit(4 * k + p)) for p in (3, 2, 1, 0)) for k in reversed(range(4))]
    return " || ".join(f"CASE WHEN {g} <> '' THEN {g} || '{J.MYRIADS[k]}' ELSE '' END" for g, k in zip(groups, reversed(range(4)), strict=True))


@query("number_readings", f"SELECT o_orderkey, n, {_number_sql('n')} AS reading FROM (SELECT o_orderkey, (o_orderkey * 10007 % 999999999989 + 1)::VARCHAR AS n FROM orders)")
def number_readings(spark, sf_dir):
    n = ((F.col("o_orderkey") * 10007) % 999999999989 + 1).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n")).select("o_orderkey", "n", J.number_reading(F.col("n")).alias("reading"))


#: Digits of a key as kana, so that keys are words with long marks and rows of every vowel.
KANA_OF_DIGITS = "アーコおケえオいメか"


def _hiragana_sql(text: str) -> str:
    """Katakana as hiragana; marks after them as vowels, one of a run at a time."""
    for rows, vowel in (("ア", "あ"), ("コオ", "う"), ("ケメ", "え")):
        for _ in range(7):
            text = f"regexp_replace({text}, '([{rows}]{vowel}*)ー', '\\1{vowel}', 'g')"
    return f"translate({text}, 'アコケオメ', 'あこけおめ')"


@query("kana_keys", f"""WITH w AS (SELECT c_custkey, translate(c_custkey::VARCHAR, '0123456789', '{KANA_OF_DIGITS}') AS word FROM customer),
    m AS (SELECT *, regexp_full_match(word, '[ぁ-ゖー]+') AS hiragana, regexp_full_match(word, '[ァ-ヺー・]+') AS katakana FROM w),
    h AS (SELECT *, CASE WHEN strpos(word, 'ー') > 0 THEN {_hiragana_sql("replace(replace(replace(word, 'あ', 'A'), 'う', 'U'), 'え', 'E')")} ELSE translate(word, 'アコケオメ', 'あこけおめ') END AS marked FROM m),
    f AS (SELECT *, replace(replace(replace(marked, 'A', 'あ'), 'U', 'う'), 'E', 'え') AS folded FROM h)
    SELECT c_custkey, word, hiragana AS is_hiragana, katakana AS is_katakana, folded AS hiragana, translate(word, 'アコケオメ', 'あこけおめ') AS fold, translate(word, 'おえいか', 'オエイカ') AS katakana,
        CASE WHEN regexp_full_match(folded, '[ぁ-ゖー]+') THEN regexp_replace(regexp_replace(folded, '([おこ])お', '\\1う', 'g'), '([けめ])え', '\\1い', 'g') ELSE folded END AS key FROM f""")
def kana_keys(spark, sf_dir):
    w = F.col("word")
    df = table(spark, sf_dir, "customer").select("c_custkey", F.translate(F.col("c_custkey").cast("string"), "0123456789", KANA_OF_DIGITS).alias("word"))
    return df.select("c_custkey", "word", T.is_hiragana(w).alias("is_hiragana"), T.is_katakana(w).alias("is_katakana"), T.to_hiragana(w).alias("hiragana"), T.fold_katakana(w).alias("fold"), T.to_katakana(w).alias("katakana"), T.comparison_key(w).alias("key"))


@query("lemma_choice", """WITH p AS (SELECT p_partkey, p_type, p_brand, split_part(p_name, ' ', 1) AS form, split_part(p_name, ' ', 2) AS reading, p_size FROM part),
    d AS (SELECT form, reading, p_type, min(p_size) AS v FROM p GROUP BY ALL), f AS (SELECT form, reading, round(count(*) / sum(1.0::DOUBLE / v))::BIGINT AS frequency FROM d GROUP BY form, reading)
    SELECT p_brand AS word_id, arg_min(p.form, (CASE WHEN p_size = 1 THEN 0 ELSE 1 END, frequency, p_partkey)) AS lemma, arg_min(p.reading, (CASE WHEN p_size = 1 THEN 0 ELSE 1 END, frequency, p_partkey)) AS lemma_reading
    FROM p JOIN f ON p.form = f.form AND p.reading = f.reading GROUP BY p_brand""")
def lemma_choice(spark, sf_dir):
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    part = table(spark, sf_dir, "part")
    candidates = part.select(F.col("p_brand").alias("word_id"), F.col("p_partkey").alias("cand_ord"), word(1).alias("form"), word(2).alias("reading"), word(1).alias("surface"), F.lit("Noun").alias("pos"), (F.col("p_size") == 1).alias("own"))
    entries = part.select(F.col("p_type").alias("dict"), word(1).alias("term"), word(2).alias("reading"), F.col("p_size").cast("long").alias("value"), F.lit(False).alias("kana_marker"), F.col("p_partkey").alias("entry_ord"))
    return frequency.choose_lemma(candidates, entries)


#: A vocabulary of customers and the best card of forms f(id, word, reading) in it, as SQL.
CARDS = "v AS (SELECT c_custkey AS idx, 'w' || c_custkey % 60 AS card, 'r' || c_custkey % 40 AS card_reading, CASE WHEN c_custkey % 45 > 0 THEN (c_custkey % 45)::DOUBLE END AS ivl FROM customer)"
BEST = """k AS (SELECT id, idx, ivl, CASE WHEN word = card AND reading = card_reading THEN 1.0 WHEN word = card THEN 0.85 ELSE 0.55 END AS score, CASE WHEN reading = card_reading THEN 0 ELSE 1 END AS rank FROM f JOIN v ON word = card OR reading = card_reading),
    best AS (SELECT id, max(score) AS score, coalesce(arg_min(coalesce(ivl, 1.0), (-score, rank, idx)), 1.0) AS days FROM k GROUP BY id)"""
DAYS_SHARE = "CASE WHEN days + 1 >= 31 THEN 1.0::DOUBLE ELSE ln(days + 1) / ln(31.0::DOUBLE) END"


def _cards(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("vocab_idx"), F.concat(F.lit("w"), (k % 60).cast("string")).alias("term"), F.concat(F.lit("r"), (k % 40).cast("string")).alias("reading"), F.when(k % 45 > 0, (k % 45).cast("double")).alias("interval"))


@query("matched_terms", f"""WITH {CARDS}, t AS (SELECT p_partkey AS term_id, 'w' || p_partkey % 70 AS lemma, 'r' || p_partkey % 55 AS reading, 'w' || p_partkey % 90 AS surface FROM part),
    f AS (SELECT term_id * 2 AS id, lemma AS word, reading FROM t UNION ALL SELECT term_id * 2 + 1, surface, reading FROM t), {BEST},
    one AS (SELECT id // 2 AS term_id, max(score) AS score, arg_max(days, (score, -(id % 2))) AS days FROM best GROUP BY id // 2)
    SELECT t.term_id, coalesce(score, 0)::DOUBLE AS score, coalesce(score, 0) >= 0.6 AS known, floor(coalesce({DAYS_SHARE}, ln(2.0::DOUBLE) / ln(31.0::DOUBLE)) * 1000 + 0.5)::BIGINT AS mille FROM t LEFT JOIN one ON t.term_id = one.term_id""")
def matched_terms(spark, sf_dir):
    k = F.col("p_partkey")
    word = lambda name, n: F.concat(F.lit(name), (k % n).cast("string"))
    t = table(spark, sf_dir, "part").select(k.alias("term_id"), word("w", 70).alias("lemma"), word("r", 55).alias("lemma_reading"), word("w", 90).alias("surface"), word("r", 55).alias("surface_reading"), F.lit("Noun").alias("pos"))
    df = vocabulary.match_terms(t, _cards(spark, sf_dir))
    return df.select("term_id", "score", "known", F.floor(F.col("comprehension") * 1000 + 0.5).alias("mille"))


@query("level_coverage", f"""WITH {CARDS}, j AS (SELECT p_partkey AS id, 'w' || p_partkey % 75 AS word, 'r' || p_partkey % 50 AS reading, 'N' || (1 + p_size % 5) AS band FROM part), f AS (SELECT id, word, reading FROM j), {BEST},
    c AS (SELECT id, {DAYS_SHARE} AS c FROM best WHERE score >= 0.6)
    SELECT band, floor(avg(CASE WHEN c IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) * 1000000 + 0.5)::BIGINT AS coverage_millionths, floor(avg(coalesce(c, 0.0::DOUBLE)) * 1000000 + 0.5)::BIGINT AS comprehension_millionths, count(*) AS total FROM j LEFT JOIN c ON j.id = c.id GROUP BY band""")
def level_coverage(spark, sf_dir):
    k = F.col("p_partkey")
    jlpt = table(spark, sf_dir, "part").select(F.concat(F.lit("N"), (1 + F.col("p_size") % 5).cast("string")).alias("level"), F.concat(F.lit("w"), (k % 75).cast("string")).alias("kanji"), F.concat(F.lit("r"), (k % 50).cast("string")).alias("kana"), F.lit("Noun").alias("pos"))
    df = summary.level_summary(jlpt, _cards(spark, sf_dir))
    part = lambda c: F.floor(F.col(c) * 1000000 + 0.5).alias(f"{c}_millionths")
    return df.select("band", part("coverage"), part("comprehension"), "total")


@query("part_split", f"""WITH RECURSIVE l AS (SELECT doc_id AS chapter, unnest(range(len(ls))) AS ord, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
    t AS (SELECT chapter, sum(length(line)) AS total, greatest(1, (sum(length(line)) + {books.PART_CHARS // 2}) // {books.PART_CHARS}) AS parts FROM l GROUP BY chapter),
    s AS (SELECT chapter, 0::BIGINT AS ord, 0::HUGEINT AS done, 0::HUGEINT AS part, 0::HUGEINT AS of, 0::BIGINT AS n FROM t
          UNION ALL SELECT s.chapter, s.ord + 1, done + length(line), part + CASE WHEN part + 1 < parts AND (done + length(line)) * parts >= total * (part + 1) THEN 1 ELSE 0 END, part, length(line)
          FROM s JOIN l ON s.chapter = l.chapter AND s.ord = l.ord JOIN t ON s.chapter = t.chapter)
    SELECT chapter, of::INT AS part, count(*) AS n_lines, sum(n)::BIGINT AS n_chars FROM s WHERE ord > 0 GROUP BY chapter, of""")
def part_split(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "line"))
    return books.split_chapters(lines).groupBy("chapter", "part").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@query("page_lines", r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<rt\b[^>]*>.*?</rt\s*>|<rp\b[^>]*>.*?</rp\s*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>|<title\b[^>]*>.*?</title\s*>', '', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|aside|blockquote|body|br|hr|dd|dt|dl|figure|figcaption|pre)\b[^>]*>', chr(10), 'g'), '<[^<>]*>', '', 'g') AS t FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM b),
    d AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS ls FROM c)
    SELECT page_id, unnest(range(len(ls)))::INT AS ord, unnest(ls) AS line FROM d""")
def page_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.html_lines(F.col("html"))).alias("ord", "line"))

"""Queries of the ingest gates and text cleaning (Q1-Q3, Q5-Q8, Q21, T3, T12-T14, S9, S10); the twins spell out their own words."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorloom.functions import gates
from motorloom.functions import text as tx
from motorloom.operators import entities as en
from motorloom.plans.entities import _phrase, _runs
from motorloom.plans.registry import query
from motorloom.sources.tables import table

RAW = "raw_documents"
#: Sources that are channels.
CHANNEL = "kanal"


def _count(words: str) -> str:
    return "(" + " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in words.split("|")) + ")"


_SALE = _count("продам|продаю|продается|продаётся|продажа|в продаже|в наличии|срочно продам|торг|обмен|рассмотрю обмен|for sale|sale|selling|sell")
_TALK = _count("ищу|куплю|нужен|нужна|подскажите|помогите|обсуждение|вопрос|что лучше|ремонт|не заводится|ошибка|диагностика|looking for|help|question|repair")
_PRICED = r"regexp_matches(t, '(^|[^0-9a-zа-яё_])[0-9]+([.,][0-9]+)?(\s(руб|₽|р|долл|usd|€|eur|тыс|к|k|млн|m)|₽|€)|[0-9][0-9\s]\s(млн|миллион|m|тыс|к|k|₽|руб|р|долл|usd|€|eur)')"
_SCORE = f"(2 * {_SALE} + CAST({_PRICED} AS INT) - 2 * {_TALK})"
_CPRICE = r"regexp_matches(t, '[0-9][0-9\s.]{1,15}\s*(млн|миллион|🍋|лимон|₽|руб|р|тыс|k|к|[$]|€|usd|eur)')"
_CSCORE = f"""(2 * {_count('продам|продаю|продается|продаётся|продажа|срочно продам|торг|обмен|рассмотрю обмен|for sale|selling|sell')} + CAST({_CPRICE} AS INT) + CAST(regexp_matches(t, '[+]?[0-9][0-9()\\s-]{{8,}}') AS INT)
  + 0.5 * CAST(regexp_matches(t, '[0-9][0-9\\s]{{1,8}}\\s*км') AS INT) + 0.5 * {_count('двигатель|пробег|год|комплектация|коробка')} - 2 * {_count('ищу|куплю|нужен|подскажите|помогите|вопрос|looking for|help|question|repair')})"""
_NAMED = f"(SELECT DISTINCT id FROM {_runs('raw_documents', 'id', 'content')} WHERE run IN (SELECT {_phrase('alias_norm')} FROM brand_aliases))"
_POSTS = f"(SELECT r.id, source, lower(coalesce(content, '')) AS t, starts_with(coalesce(source, ''), 'kanal') AS ch, n.id IS NOT NULL AS named FROM raw_documents r LEFT JOIN {_NAMED} n ON n.id = r.id)"
_NOISE = f"""({_count('подписывайтесь|репост|лайк|разбор|запчаст|км/ч|скорость')} > 0 OR regexp_matches(t, 't(elegram)?[.]me/joinchat/|подпис(ывай|ыва)т(ь|есь)|подел(ись|итесь)')
  OR ({_PRICED} AND NOT named AND {_count('это норм|это цена|шутка|реальная цена|подскажите|кто знает|?')} > 0))"""
_YEAR = "regexp_matches(t, '(^|[^0-9a-zа-яё_])(19|20)[0-9]{2}([^0-9a-zа-яё_]|$)')"
_SKIP = f"""CASE WHEN t = '' THEN 'empty_text' WHEN ch AND {_NOISE} THEN 'telegram_noise'
  WHEN {_count('фары отдельно|бампер отдельно|капот отдельно|дверь отдельно|крыло отдельно|редуктор отдельно|двигатель отдельно|акпп отдельно|кпп отдельно|ноускат|разборка|на запчасти')} > 0 THEN 'parts_listing'
  WHEN length(trim(t)) < 40 AND {_SCORE} < 2 AND NOT ch AND NOT named AND NOT {_PRICED} AND NOT {_YEAR} THEN 'too_short'
  WHEN {_count('ищу|куплю|что лучше|ремонт|диагностика|ошибка|проблема|запчасти|разбор')} > 0 AND {_SCORE} < 2 AND NOT named AND NOT {_PRICED} THEN 'blacklist_word'
  WHEN NOT (named OR {_PRICED} OR {_YEAR} OR regexp_matches(t, '[0-9]\\s') OR regexp_matches(t, 'бензин|дизель|гибрид|электро|газ|hybrid|diesel|petrol|electric|ev')) AND {_SCORE} < 2
    THEN CASE WHEN ch THEN 'low_entity_signal' ELSE 'low_entity_signal_marketplace' END ELSE 'ok' END"""


def _posts(s, d):
    """Posts with whether they come from a channel and whether they name a brand."""
    rows = table(s, d, RAW)
    named = en.hits(rows, "id", F.col("content"), table(s, d, "brand_aliases")).select("id", F.lit(True).alias("named")).distinct()
    posts = rows.select("id", "source", "content").join(named, "id", "left")
    return posts.withColumns({"named": F.coalesce("named", F.lit(False)), "ch": F.coalesce(F.col("source").startswith(CHANNEL), F.lit(False))})


@query("q01_sale_score", f"SELECT id, CAST({_SCORE} AS INT) AS score FROM (SELECT id, lower(content) AS t FROM raw_documents)")
def q01(s, d):
    return table(s, d, RAW).select("id", gates.sale_score(F.col("content")).alias("score"))


@query("q02_channel_sale_score", f"SELECT id, CAST({_CSCORE} AS DOUBLE) AS score FROM (SELECT id, lower(content) AS t FROM raw_documents)")
def q02(s, d):
    return table(s, d, RAW).select("id", gates.channel_sale_score(F.col("content")).cast("double").alias("score"))


@query("q03_sale_flag", "SELECT id, regexp_matches(lower(content), 'продам|продаю|продажа|цена|₽|руб') AS sale FROM raw_documents")
def q03(s, d):
    return table(s, d, RAW).select("id", gates.sale_flag(F.col("content")).alias("sale"))


@query("q05_skip_reason", f"SELECT id, {_SKIP} AS reason FROM {_POSTS}")
def q05(s, d):
    return _posts(s, d).select("id", gates.skip_reason(F.col("content"), F.col("ch"), F.col("named")).alias("reason"))


@query("q06_noise", f"SELECT id, {_NOISE} AS noise FROM {_POSTS}")
def q06(s, d):
    return _posts(s, d).select("id", gates.noise(F.coalesce("content", F.lit("")), F.col("named")).alias("noise"))


_STOP = "подписывайтесь|вакансия|работа|акция|обсуждение|опрос|новости|ремонт|диагностика|ошибка|запчасти|разбор|по запчастям|подскажите|вопрос|приобрету|сервис|колодки|ваносы|ксентри|xentry|кодирование|чиптюнинг|чип тюнинг"


@query("q07_channel_post", f"""SELECT id, CASE WHEN raw = '' THEN 'spam' WHEN NOT regexp_matches(t, '(^|[^0-9a-zа-яё_])(19[89][0-9]|20[0-2][0-9])([^0-9a-zа-яё_]|$)|(^|[^0-9])([89][0-9]|[012][0-9])\\s*(год|г[.]?\\s|\\s)') THEN 'no_year_found'
  WHEN len(regexp_extract_all(t, '[\\x{{2711}}-\\x{{10FFFF}}]')) > 20 THEN 'emoji_spam' WHEN len(regexp_extract_all(t, '@')) > 5 THEN 'mention_spam' WHEN len(regexp_extract_all(t, 'http')) > 3 THEN 'link_spam'
  WHEN {_count('подпишись|подписывайтесь|ссылка в био|мой канал|перейдите')} > 0 THEN 'spam_pattern' WHEN length(t) < 40 THEN 'too_short'
  WHEN regexp_matches(t, '(^|[^0-9a-zа-яё_])({_STOP})([^0-9a-zа-яё_]|$)') THEN 'blocked_by_stop_word' WHEN named AND ({_CPRICE} OR ({_CSCORE} >= 2 AND length(t) >= 80)) THEN 'ok'
  WHEN NOT named THEN 'no_car_entity' WHEN NOT {_CPRICE} THEN 'no_price' ELSE 'discussion' END AS reason FROM (SELECT id, t AS raw, trim(t) AS t, named FROM {_POSTS})""")
def q07(s, d):
    return _posts(s, d).select("id", gates.channel_post(F.col("content"), F.col("named")).alias("reason"))


@query("q08_entity_present", f"SELECT id FROM {_NAMED}")
def q08(s, d):
    return en.hits(table(s, d, RAW), "id", F.col("content"), table(s, d, "brand_aliases")).select("id").distinct()


@query("q21_skip_counts", f"SELECT reason, count(*) AS n FROM (SELECT {_SKIP} AS reason FROM {_POSTS}) GROUP BY 1")
def q21(s, d):
    return q05(s, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_SP = r"'[\s\x{00A0}]+'"


@query("t03_clean_text", f"SELECT id, trim(regexp_replace(regexp_replace(replace(coalesce(content, ''), '₽', ' ₽ '), 'Спецтехника|Отзывы|Каталог|Шины|Форумы|ОСАГО|ПДД|Проверка по VIN', '', 'g'), {_SP}, ' ', 'g')) AS t FROM raw_documents")
def t03(s, d):
    return table(s, d, RAW).select("id", tx.clean_text(F.col("content")).alias("t"))


@query("t12_thousands", r"SELECT id, regexp_replace(normalized_text, '(^|[^0-9])([0-9]{1,3})[.,]([0-9]{3})($|[^0-9])', '\1\2\3\4', 'g') AS t FROM normalized_documents")
def t12(s, d):
    return table(s, d, "normalized_documents").select("id", tx.thousands(F.col("normalized_text")).alias("t"))


@query("t13_strip_frame", r"""SELECT id, CASE WHEN length(head) > 200 THEN trim(head) ELSE out END AS t FROM (SELECT id, out,
  regexp_extract(out, '(?s)^((?:.*?(?:^|[^0-9a-zа-яёA-ZА-ЯЁ_])[0-9][0-9\s]{2,10}\s*₽){3}.*?(?:^|[^0-9a-zа-яёA-ZА-ЯЁ_]))[0-9][0-9\s]{2,10}\s*₽', 1) AS head FROM (SELECT id, CASE WHEN p IS NULL THEN content ELSE trim(substring(content, 1, p - 1)) END AS out
  FROM (SELECT id, content, list_filter([instr(content, 'Отзывы владельцев'), instr(content, 'Мнения владельцев'), instr(content, 'Вы смотрите раздел'), instr(content, 'В разделе "Продажа авто"'), instr(content, 'Запчасти на'), instr(content, 'Статистика цен'),
    instr(content, 'О проекте Помощь Правила Для СМИ')], lambda x: x > 200)[1] AS p FROM raw_documents)))""")
def t13(s, d):
    return table(s, d, RAW).select("id", tx.strip_frame(F.col("content")).alias("t"))


@query("t14_meta_build", """SELECT id, CASE WHEN m = '' THEN normalized_text ELSE '_meta_: ' || m || chr(10) || coalesce(normalized_text, '') END AS t, CASE WHEN brand IS NOT NULL THEN trim(brand) END AS back
  FROM (SELECT id, normalized_text, brand, concat_ws('; ', 'brand=' || brand, 'year=' || CAST(year AS VARCHAR), 'price=' || CAST(price AS VARCHAR)) AS m FROM normalized_documents)""")
def t14(s, d):
    """Header built and read back."""
    c = F.col
    built = table(s, d, "normalized_documents").select("id", tx.meta_build({"brand": c("brand"), "year": c("year"), "price": c("price")}, c("normalized_text")).alias("t"))
    return built.select("id", "t", F.trim(F.try_element_at(tx.meta_map(c("t")), F.lit("brand"))).alias("back"))


@query("s09_html_text", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'),
  '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS t FROM documents""")
def s09(s, d):
    return table(s, d, "documents").select("doc_id", tx.html_text(F.col("text")).alias("t"))


@query("s10_forum_text", r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(content, '(?is)\[quote[^\]]*\].*?\[/quote\]', ' ', 'g'), '(?i)(sent from|отправлено)[^\n]*', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g')) AS t FROM raw_documents")
def s10(s, d):
    return table(s, d, RAW).select("id", tx.forum_text(F.col("content")).alias("t"))

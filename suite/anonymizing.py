"""Anonymizing over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bucketwise.operators import anonymize as an
from suite.registry import register, table

# The patterns of the default rules, as the SQL side writes them.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
ENCODED = r"[a-zA-Z0-9._+\-]+%40[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
IBAN = r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7,}\b"


def masked_sql(text: str) -> str:
    for pattern, mark in ((EMAIL, "<EMAIL>"), (ENCODED, "<EMAIL>"), (IPV4, "<IP>"), (IPV6, "<IP6>"), (IBAN, "<IBAN>")):
        text = f"regexp_replace({text}, '{pattern}', '{mark}', 'g')"
    return text


def secrets_sql(text: str) -> str:
    bytes_of = "list_transform(range(0, octet_length(encode(t))), lambda i: substr(hex(encode(t)), 2 * i + 1, 2))"
    return rf"""array_to_string(list_transform(regexp_extract_all({text}, '[^\t\n\f\r ]+|[\t\n\f\r ]+'),
      lambda t: CASE WHEN octet_length(encode(t)) >= 12 AND list_aggregate({bytes_of}, 'entropy') >= 4.8 THEN '<SECRET>' ELSE t END), '')"""


@register("an1_an3_chain_by_column", """
SELECT c_custkey, 'S0ME0NE' AS c_name, 'N' AS c_nationkey, regexp_replace(c_mktsegment, 'O', '0', 'g') AS c_mktsegment FROM customer""")
def _(spark, folder):
    rules = an.chain(an.by_column({"C_NAME": an.replace_with("SOMEONE"), "c_nationkey": an.replace_with("N")}), None,
                     an.text_pattern("O", "0"), an.drop_fields("c_acctbal"))
    return an.anonymize(table(spark, folder, "customer"), rules)


@register("an2_nested_fields", """
SELECT event_id, event_type AS kind, '<ID>' AS tag, '<ID>' AS in_map, 'X' AS owner FROM events""")
def _(spark, folder):
    nested = table(spark, folder, "events").select(
        "event_id", F.struct(
            F.col("event_type").alias("kind"), F.lit("secret").alias("hidden"),
            F.array(F.concat(F.lit("id-"), "user_id")).alias("tags"),
            F.create_map(F.lit("user"), F.concat(F.lit("id-"), "user_id"), F.lit("owner"), F.lit("me")).alias("more"),
        ).alias("body"))
    rules = an.chain(an.drop_fields("hidden"), an.by_column({"owner": an.replace_with("X")}), an.text_pattern("^id-[0-9]+$", "<ID>"))
    return an.anonymize(nested, rules).select(
        "event_id", "body.kind", F.col("body.tags")[0].alias("tag"), F.col("body.more")["user"].alias("in_map"),
        F.col("body.more")["owner"].alias("owner"))


def scrub(spark, rows, rules):
    """Rows are dealt out only where the session asks for a number of file partitions."""
    asked = spark.conf.get("spark.sql.files.minPartitionNum", None)
    return an.anonymize(rows, rules, partitions=int(asked) if asked else None)


EMAIL_RULE = (r"[a-z0-9]+@[a-z0-9.]+", "<EMAIL>")


@register("an4_text_patterns", f"SELECT doc_id, {masked_sql('text')} AS text FROM documents")
def masked_documents(spark, folder):
    rules = an.chain(*[an.text_pattern(*rule) for rule in an.PATTERNS])
    return scrub(spark, table(spark, folder, "documents").select("doc_id", "text"), rules)


@register("an5_random_tokens", f"SELECT doc_id, {secrets_sql('text')} AS text FROM documents")
def _(spark, folder):
    return scrub(spark, table(spark, folder, "documents").select("doc_id", "text"), an.redact_random_tokens(4.8, 12))


@register("an6_entropy", """
SELECT page_id, round(list_aggregate(list_transform(range(0, octet_length(encode(url))),
  lambda i: substr(hex(encode(url)), 2 * i + 1, 2)), 'entropy'), 6) AS entropy FROM pages""")
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.round(an.shannon_entropy(F.col("url")), 6).alias("entropy"))


@register("an7_drop_and_truncate", "SELECT conv_id, turn, '<TRUNCATED>' AS text FROM conversations")
def _(spark, folder):
    return an.anonymize(table(spark, folder, "conversations"), an.chain(an.drop_fields("role"), an.truncate_fields("text")))


@register("an7_drop_in_maps", """
SELECT event_id, 1 AS entries, 'user <EMAIL>' AS note, CAST(2 AS INTEGER) AS numbered, '<EMAIL>' AS second FROM events""")
def _(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id", F.create_map(F.lit("password"), F.concat(F.lit("p"), "user_id"), F.lit("note"), F.lit("user a@b.com")).alias("m"),
        F.create_map(F.lit(1), F.lit("plain"), F.lit(2), F.lit("c@d.net")).alias("n"))
    out = an.anonymize(rows, an.chain(an.drop_fields("password"), an.text_pattern(*EMAIL_RULE)))
    return out.select("event_id", F.size("m").alias("entries"), F.col("m")["note"].alias("note"), F.size("n").alias("numbered"),
                      F.col("n")[2].alias("second"))


@register("an2_variant_fields", """
SELECT event_id, '<EMAIL>' AS mail, CAST(user_id AS VARCHAR) AS uid FROM events""")
def _(spark, folder):
    text = F.format_string('{"mail": "u%s@example.org", "ids": [%s]}', F.col("user_id").cast("string"), F.col("user_id").cast("string"))
    rows = an.dealt(table(spark, folder, "events").select("event_id", "user_id")).select("event_id", F.parse_json(text).alias("v"))
    out = an.anonymize(rows, an.text_pattern(*EMAIL_RULE))
    return out.select("event_id", F.expr("variant_get(v, '$.mail', 'string')").alias("mail"),
                      F.expr("variant_get(v, '$.ids[0]', 'string')").alias("uid"))


@register("an2_variant_rules", """
SELECT event_id, '{"Owner":{"list":[{"user_name":"N"},"<EMAIL>"],"user_name":"N"},"blob":"<TRUNCATED>","deep":{"a":{"b":[{"c":{"user_name":"N","x":'
  || user_id || '}}]}},"user_name":"N"}' AS v FROM events""")
def _(spark, folder):
    text = F.expr("""concat('{"user_name":', user_id, ',"password":"p', user_id, '","blob":{"big":[1,2]},"Owner":{"password":{"p":1},"user_name":"u',
      user_id, '","list":[{"user_name":"x","password":null},"u', user_id, '@example.org"]},"deep":{"a":{"b":[{"c":{"user_name":"y","x":', user_id, '}}]}}}')""")
    rows = an.dealt(table(spark, folder, "events").select("event_id", "user_id")).select("event_id", F.parse_json(text).alias("v"))
    rules = an.chain(an.drop_fields("password"), an.truncate_fields("blob"), an.by_column({"USER_NAME": an.replace_with("N")}),
                     an.text_pattern(*EMAIL_RULE))
    return an.anonymize(rows, rules).select("event_id", F.to_json("v").alias("v"))


# The checksum's table of 256 entries, from its rule.
CRC_TABLE = """WITH RECURSIVE step AS (
  SELECT i, i::UINTEGER AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM step WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """Checksum of a text, where ``tab`` is the table above."""
    return f"""xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(range(0, octet_length(encode({text}))),
      lambda o: ('0x' || substr(hex(encode({text})), 1 + 2 * o, 2))::UINTEGER)),
      lambda c, b: xor(tab[1 + xor(c & 255::UINTEGER, b)], c >> 8)), 4294967295::UINTEGER)"""


def scrambled_sql(text: str) -> str:
    """One character after the other: the generator's state and the text so far."""
    state = "((a.s * 1103515245 + 12345 + i - 2) & 2147483647)"  # i is 2 at the first character
    letter = f"""CASE WHEN x.o BETWEEN 'a' AND 'z' THEN chr((97 + {state} % 26)::INTEGER) WHEN x.o BETWEEN 'A' AND 'Z' THEN chr((65 + {state} % 26)::INTEGER)
      WHEN x.o BETWEEN '0' AND '9' THEN chr((48 + {state} % 10)::INTEGER) ELSE x.o END"""
    return f"""list_reduce(list_prepend({{'s': ({crc_sql(text)} & 2147483647)::BIGINT, 'o': ''}},
      list_transform(string_split({text}, ''), lambda ch: {{'s': 0::BIGINT, 'o': ch}})),
      lambda a, x, i: {{'s': {state}, 'o': a.o || {letter}}}).o"""


V4 = "concat_ws('.', 10, user_id % 250, event_id % 250, 7)"
V6 = "concat('fe80::', lower(to_hex(user_id)), ':', lower(to_hex(event_id % 65536)))"


@register("an8_scrambled_names", f"{CRC_TABLE} SELECT c_custkey, {scrambled_sql('c_name')} AS c_name FROM customer, crc")
def _(spark, folder):
    rows = an.dealt(table(spark, folder, "customer").select("c_custkey", "c_name"))
    return rows.select("c_custkey", an.scramble(F.col("c_name")).alias("c_name"))


@register("an9_scrambled_addresses", f"""{CRC_TABLE}
SELECT event_id, concat_ws('.', h >> 24, (h >> 16) & 255, (h >> 8) & 255, h & 255) AS v4,
  array_to_string(list_transform(string_split(v6, ':'), lambda seg, k:
    CASE WHEN seg = '' THEN '' ELSE printf('%04x', ({crc_sql("(v6 || ':' || (k - 1))")} & 65535)::BIGINT) END), ':') AS v6
FROM (SELECT event_id, {crc_sql(V4)} AS h, {V6} AS v6 FROM events, crc), crc""")
def _(spark, folder):
    v4 = F.concat_ws(".", F.lit("10"), (F.col("user_id") % 250).cast("string"), (F.col("event_id") % 250).cast("string"), F.lit("7"))
    v6 = F.concat(F.lit("fe80::"), F.lower(F.hex("user_id")), F.lit(":"), F.lower(F.hex(F.col("event_id") % 65536)))
    rows = an.dealt(table(spark, folder, "events").select("event_id", "user_id")).select("event_id", v4.alias("v4"), v6.alias("v6"))
    return rows.select("event_id", an.scramble_ip(F.col("v4")).alias("v4"), an.scramble_ip(F.col("v6")).alias("v6"))


MAILS = ("email", "User_Email", "email_address")
ADDRESSES = ("ip", "ip_address", "REMOTE_ADDR", "remote_ip", "client_ip", "request__remote_ip", "request__client_ip", "X_Forwarded_For")
PEOPLE = ("username", "user_name", "Full_Name", "first_name", "last_name")


@register("an10_named_columns", f"""{CRC_TABLE}
SELECT c_custkey, {", ".join(f"'<EMAIL>' AS {c}" for c in MAILS)}, {", ".join(f"'<IP>' AS {c}" for c in ADDRESSES)},
  {", ".join(f"{scrambled_sql('n')} AS {c}" for c in PEOPLE)}, 'REDACTED' AS user_agent, 'R. <EMAIL>' AS remark
FROM (SELECT c_custkey, concat('Jane ', c_name) AS n FROM customer), crc""")
def named_columns(spark, folder):
    rows = an.dealt(table(spark, folder, "customer").select("c_custkey", "c_name"))
    mail = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.org"))
    address = F.concat_ws(".", F.lit("10.1"), (F.col("c_custkey") % 250).cast("string"), F.lit("9"))
    columns = [*(mail.alias(c) for c in MAILS), *(address.alias(c) for c in ADDRESSES),
               *(F.concat(F.lit("Jane "), "c_name").alias(c) for c in PEOPLE)]
    return an.anonymize(rows.select("c_custkey", *columns, F.lit("agent").alias("user_agent"), F.concat(F.lit("R. "), mail).alias("remark")),
                        an.default_rules())


@register("an10_named_fields_in_variants", f"""{CRC_TABLE}
SELECT c_custkey, concat('{{"client":{{"Email":"<EMAIL>","ip":["<IP>","<IP>"],"user_agent":"REDACTED"}},"full_name":"',
  {scrambled_sql('c_name')}, '","remark":"R. <EMAIL>"}}') AS v FROM customer, crc""")
def _(spark, folder):
    text = F.expr("""concat('{"client":{"Email":"u', c_custkey, '@example.org","ip":["10.1.1.', c_custkey % 250, '","10.0.0.1"],"user_agent":7},
      "full_name":"', c_name, '","remark":"R. u', c_custkey, '@example.org"}')""")
    rows = an.dealt(table(spark, folder, "customer").select("c_custkey", "c_name")).select("c_custkey", F.parse_json(text).alias("v"))
    return an.anonymize(rows, an.default_rules()).select("c_custkey", F.to_json("v").alias("v"))


@register("an10_default_rules_documents", f"""
SELECT doc_id, lang, source, {secrets_sql('masked')} AS text FROM (SELECT *, {masked_sql('text')} AS masked FROM documents)""")
def default_documents(spark, folder):
    return scrub(spark, table(spark, folder, "documents").select("doc_id", "lang", "source", "text"), an.default_rules())


@register("an10_default_rules_conversations", f"""
SELECT conv_id, turn, role, {secrets_sql('masked')} AS text FROM (SELECT *, {masked_sql('text')} AS masked FROM conversations)""")
def _(spark, folder):
    return scrub(spark, table(spark, folder, "conversations"), an.default_rules())


@register("an10_default_rules_pages", f"""
SELECT page_id, {secrets_sql('u')} AS url, {secrets_sql('h')} AS html FROM (
  SELECT page_id, {masked_sql('url')} AS u, {masked_sql('html')} AS h FROM pages)""")
def _(spark, folder):
    return scrub(spark, table(spark, folder, "pages"), an.default_rules())


@register("u1_custom_rule", """
SELECT c_custkey, c_nationkey, c_acctbal, upper(c_mktsegment) AS c_mktsegment FROM customer""")
def _(spark, folder):
    rule = an.custom(lambda name, text: an.DROP if name == "c_name" else F.upper(F.lower(text)))
    return an.anonymize(table(spark, folder, "customer"), an.chain(rule, None))

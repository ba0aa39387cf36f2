"""The given tables and the views that give them the shapes of a wiki and a chat.

Each view is one portable SQL text, so that a check in another engine starts
from the very same rows.  Names in braces are other tables or views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BOT = "UBOT"
BASE_URL = "https://wiki.example.org/team/home"

VIEWS = {
    # Files of a wiki: stems collide in pairs, some names are hidden, some
    # extensions are unsupported.
    "wiki_files": """
        SELECT doc_id,
               concat('dir', CAST(k % 20 AS STRING), '/',
                      CASE WHEN k % 11 = 0 THEN '_' WHEN k % 13 = 0 THEN '.' ELSE '' END,
                      'page-', CAST(k AS STRING), '.',
                      CASE doc_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'org' WHEN 2 THEN 'rst'
                                      WHEN 3 THEN 'txt' ELSE 'png' END) AS path,
               text, lang
        FROM (SELECT doc_id, text, lang,
                     CASE WHEN doc_id % 10 = 1 THEN doc_id - 1 ELSE doc_id END AS k
              FROM {documents}) AS numbered""",
    # Names as people type them; some are no valid part of a link.
    "file_names": """
        SELECT doc_id, concat(CASE lang WHEN 'es' THEN 'año/' WHEN 'fr' THEN 'two words/' WHEN 'de' THEN 'x:y/'
                                        ELSE '' END, path) AS file_name
        FROM {wiki_files}""",
    # What was indexed before: Spanish files are new since, German ones changed.
    "previous_texts": """
        SELECT path, CASE WHEN lang = 'de' THEN concat(text, ' (draft)') ELSE text END AS text
        FROM {wiki_files} WHERE lang <> 'es'""",
    # Texts edited since they were indexed.
    "revised_texts": """
        SELECT doc_id, path, concat(text, ' revised draft') AS text FROM {wiki_files} WHERE lang = 'de'""",
    # Commits of those files; the author's clock may run behind, and the
    # record of some files lacks the address.
    "commits": """
        SELECT f.path, e.event_id AS seq,
               CASE WHEN e.event_id % 3 = 0 THEN e.ts - INTERVAL 9 DAYS ELSE e.ts END AS authored_at,
               concat('user', CAST(e.user_id AS STRING)) AS author_name,
               CASE WHEN f.doc_id % 10 IN (3, 7) THEN NULL
                    ELSE concat('user', CAST(e.user_id AS STRING), '@example.org') END AS author_email
        FROM (SELECT *, event_id % (SELECT max(doc_id) + 1 FROM {documents}) AS doc_id FROM {events}) AS e
        JOIN {wiki_files} AS f ON e.doc_id = f.doc_id""",
    # The same commits as log lines; without an address only two parts, and
    # every seventh line has one part too many.
    "commit_lines": """
        SELECT seq, path,
               concat(replace(CAST(authored_at AS STRING), ' ', 'T'), '+02:00', chr(9), author_name,
                      CASE WHEN author_email IS NULL THEN '' ELSE concat(chr(9), author_email) END,
                      CASE WHEN seq % 7 = 0 THEN concat(chr(9), 'extra') ELSE '' END, chr(10)) AS line
        FROM {commits}""",
    # Texts asked for: every benchmark passage and every customer's name.
    "queries": """
        SELECT item_id AS query_id, text FROM {benchmark}""",
    "name_queries": """
        SELECT item_id AS query_id, text FROM {benchmark}
        UNION ALL
        SELECT 1000000000 + c_custkey AS query_id, c_name AS text FROM {customer}""",
    # The same with missing and blank texts among them.
    "odd_queries": """
        SELECT query_id, text FROM {name_queries}
        UNION ALL
        SELECT 2000000000 + n_nationkey AS query_id,
               CASE n_regionkey WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE n_name END AS text
        FROM {nation}""",
    "chat_users": """
        SELECT concat('U', CAST(c_custkey AS STRING)) AS user_id,
               CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END AS user_name
        FROM {customer}""",
    "chat_channels": """
        SELECT concat('C', CAST(n_nationkey AS STRING)) AS channel_id,
               lower(n_name) AS channel_name, n_regionkey < 3 AS bot_is_member
        FROM {nation}""",
    "chat_members": """
        SELECT concat('C', CAST(c_nationkey AS STRING)) AS channel_id,
               concat('U', CAST(c_custkey AS STRING)) AS user_id
        FROM {customer}""",
    "chat_messages": """
        SELECT conv_id * 1000 + turn AS message_id,
               concat(CASE WHEN conv_id % 3 = 0 THEN 'D' ELSE 'C' END,
                      CAST(CASE WHEN conv_id % 3 = 0 THEN conv_id ELSE conv_id % 25 END AS STRING)) AS channel_id,
               CASE WHEN role = 'assistant' THEN 'UBOT'
                    ELSE concat('U', CAST(conv_id % 150 AS STRING)) END AS user_id,
               CASE conv_id % 7 WHEN 3 THEN 'me_message' WHEN 4 THEN 'message_changed'
                                WHEN 5 THEN 'bot_message' ELSE NULL END AS subtype,
               concat(CASE WHEN conv_id % 4 = 0 THEN '<@UBOT> ' WHEN conv_id % 4 = 2 THEN '<@UBOT|bot>: '
                           ELSE '' END, text) AS text
        FROM {conversations}""",
    # Slash commands: the text is a benchmark passage.
    "commands": """
        SELECT e.event_id AS command_id, concat('C', CAST(e.user_id % 25 AS STRING)) AS channel_id,
               concat('U', CAST(e.user_id AS STRING)) AS user_id, q.text
        FROM (SELECT *, event_id % (SELECT max(item_id) + 1 FROM {benchmark}) AS query_id FROM {events}) AS e
        JOIN {queries} AS q ON e.query_id = q.query_id""",
    # Button presses: two actions each, the first often not usable.
    "button_events": """
        SELECT event_id, concat('U', CAST(user_id AS STRING)) AS user_id,
               CASE event_type WHEN 'click' THEN 'more' WHEN 'view' THEN 'less' ELSE event_type END AS first_name,
               CASE WHEN event_id % 9 = 0 THEN 'x' WHEN event_id % 10 = 0 THEN NULL
                    ELSE CAST(event_id % 5 AS STRING) END AS first_value,
               CASE WHEN value > 20 THEN 'more' WHEN value > 5 THEN 'less' ELSE 'other' END AS second_name,
               CAST(event_id % 4 AS STRING) AS second_value
        FROM {events}""",
    # All that a chat client delivers: messages and, numbered below zero,
    # commands, button presses and other events.
    "chat_events": """
        SELECT message_id AS event_id,
               CASE WHEN message_id % 11 = 0 THEN 'hello' WHEN subtype = 'message_changed' THEN 'hidden_message'
                    ELSE 'message' END AS kind,
               channel_id, concat(CAST(1700000000 + message_id AS STRING), '.000100') AS ts, user_id, subtype, text,
               CAST(NULL AS STRING) AS first_name, CAST(NULL AS STRING) AS first_value,
               CAST(NULL AS STRING) AS second_name, CAST(NULL AS STRING) AS second_value
        FROM {chat_messages}
        UNION ALL
        SELECT -1 - b.event_id AS event_id,
               CASE b.first_name WHEN 'more' THEN 'button' WHEN 'less' THEN 'button' WHEN 'signup' THEN 'command'
                                 ELSE b.first_name END AS kind,
               CASE WHEN b.first_name IN ('more', 'less') THEN '' ELSE c.channel_id END AS channel_id,
               concat(CAST(1800000000 + b.event_id AS STRING), '.000200') AS ts,
               b.user_id, CAST(NULL AS STRING) AS subtype, c.text,
               b.first_name, b.first_value, b.second_name, b.second_value
        FROM {button_events} AS b JOIN {commands} AS c ON b.event_id = c.command_id""",
    # The allow-list as written: a channel or a person each, and some slips.
    "rule_list": """
        SELECT concat(CASE WHEN n_regionkey IN (1, 3) THEN '#' ELSE '' END, lower(n_name)) AS rule FROM {nation}
        UNION ALL
        SELECT concat('@', c_name) AS rule FROM {customer} WHERE c_mktsegment = 'BUILDING'""",
    # Dates as written by different tools.
    "date_texts": """
        SELECT event_id,
               CASE event_id % 7
                    WHEN 0 THEN concat(replace(CAST(ts AS STRING), ' ', 'T'), '+02:00')
                    WHEN 1 THEN concat(replace(CAST(ts AS STRING), ' ', 'T'), 'Z')
                    WHEN 2 THEN CAST(1700000000000 + event_id * 1001 AS STRING)
                    WHEN 3 THEN replace(CAST(ts AS STRING), ' ', 'T')
                    WHEN 4 THEN left(CAST(ts AS STRING), 7)
                    WHEN 5 THEN left(CAST(ts AS STRING), 4)
                    ELSE concat('about ', CAST(ts AS STRING)) END AS written
        FROM {events}""",
}

TABLES = [
    "benchmark", "conversations", "customer", "documents", "events", "nation", "pages",
]


def references(sql: str) -> list[str]:
    """Names in braces, each once, in the order of their first use."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Tables:
    """Given tables and derived views of one folder, as DataFrames by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        if name in VIEWS:
            sql = VIEWS[name]
            return self.spark.sql(sql, **{used: self[used] for used in references(sql)})
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

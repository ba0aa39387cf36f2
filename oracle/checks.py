"""One statement per query for DuckDB, over the same tables.

Statements are put together from named common table expressions; names in
braces are the expressions, views and tables they use.
"""

from __future__ import annotations

from lorekeep.functions import text as words
from lorekeep.operators import access, reply
from lorekeep.sources.tables import BASE_URL, TABLES, VIEWS, references

from oracle.stem_sql import stem_steps


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


STOP_LIST = ", ".join(lit(word) for word in words.STOP_WORDS)
LETTER = r"[^\P{L}\p{Han}\p{Hiragana}]\p{M}*"
LETTERS = rf"(?:[a-z]|{LETTER})+"
TOKEN = (
    rf"(?:{LETTERS}(?:[.:·'‘’]{LETTERS})*"
    r"|\p{N}+(?:[.,;'‘’]\p{N}+)*"
    r"|_+)+"
    r"|[\p{Han}\p{Hiragana}]"
)


def tokens(value: str) -> str:
    return f"regexp_extract_all({value}, {lit(TOKEN)})"


def all_replaced(value: str, pairs: list[tuple[str, str, str]]) -> str:
    for pattern, new, options in pairs:
        value = f"regexp_replace({value}, {lit(pattern)}, {new}, '{options}')"
    return value


def stripped(html: str) -> str:
    tags = all_replaced(
        html,
        [
            (r"<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", "chr(10)", "gis"),
            ("<!--.*?-->", "''", "gs"),
            (words.INLINE_TAG.removeprefix("(?i)"), "''", "gi"),
            (words.ANY_TAG, "chr(10)", "g"),
        ],
    )
    for entity, sign in words.ENTITIES:
        tags = f"replace({tags}, {lit(entity)}, {lit(sign)})"
    return tags


def plain(html: str) -> str:
    return all_replaced(
        stripped(html),
        [(r"[ \t\r\f]+", "' '", "g"), (r" ?\n[ \n]*", "chr(10)", "g"), (r"^[ \n]+|[ \n]+$", "''", "g")],
    )


def epoch(value: str) -> str:
    return f"epoch_us({value})"


# ---------------------------------------------------- expressions by name

PARTS: dict[str, str] = {
    "sources": """
        SELECT * FROM (
            SELECT *, regexp_replace(path, '\\.[^./]*$', '') AS stem FROM {wiki_files}
            WHERE regexp_extract(path, '\\.([^./]+)$', 1) IN ('md', 'org', 'rst', 'txt')
              AND NOT regexp_matches(path, '(^|/)[._]'))
        QUALIFY row_number() OVER (PARTITION BY stem ORDER BY
            list_position(['md', 'org', 'rst', 'txt'], regexp_extract(path, '\\.([^./]+)$', 1)), path) = 1""",
    "newest": "SELECT * FROM {commits} QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1",
    "titled": """
        SELECT *, replace(regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', ''), '-', ' ') AS title
        FROM {wiki_files}""",
    "assembled": """
        SELECT f.doc_id, sha1(f.path) AS id, f.text AS content, coalesce(p.html, f.text) AS html,
               f.path AS file_name,
               replace(regexp_replace(split_part(f.path, '/', -1), '\\.[^.]*$', ''), '-', ' ') AS title,
               n.author_name AS updated_by, epoch_us(n.authored_at) AS updated_on
        FROM {sources} AS f JOIN {newest} AS n USING (path) LEFT JOIN {pages} AS p ON p.page_id = f.doc_id
        WHERE n.author_email IS NOT NULL""",
    # Analysis of the documents: one row per word, then per term.
    "doc_words": f"""
        SELECT doc_id, 'title' AS field, unnest({tokens('lower(title)')}) AS token FROM {{titled}}
        UNION ALL
        SELECT doc_id, 'content' AS field, unnest({tokens('lower(' + stripped('text') + ')')}) AS token
        FROM {{titled}}""",
    "query_words": f"""
        SELECT query_id, 'title' AS field, unnest({tokens('lower(text)')}) AS token FROM {{asked}}
        UNION ALL
        SELECT query_id, 'content' AS field, unnest({tokens('lower(' + stripped('text') + ')')}) AS token
        FROM {{asked}}""",
    "all_words": "SELECT token FROM {doc_words} UNION SELECT token FROM {query_words}",
    "doc_terms": f"""
        SELECT doc_id, field, term, count(*) AS tf FROM {{doc_words}} JOIN {{stems}} USING (token)
        WHERE field = 'title' OR term NOT IN ({STOP_LIST}) GROUP BY ALL""",
    "query_bag": f"""
        SELECT query_id, field, term, count(*) AS qtf FROM {{query_words}} JOIN {{stems}} USING (token)
        WHERE field = 'title' OR term NOT IN ({STOP_LIST}) GROUP BY ALL""",
    "lengths": "SELECT field, doc_id, CAST(sum(tf) AS BIGINT) AS dl FROM {doc_terms} GROUP BY ALL",
    "field_stats": """
        SELECT field, count(*) AS n_docs, sum(dl) / CAST(count(*) AS DOUBLE) AS avgdl FROM {lengths} GROUP BY ALL""",
    "term_stats": "SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {doc_terms} GROUP BY ALL",
    "gains": """
        SELECT q.query_id, d.doc_id, q.field, q.term,
               q.qtf * ln(1 + (s.n_docs - t.df + 0.5e0) / (t.df + 0.5e0)) * d.tf * 2.2e0
               / (d.tf + 1.2e0 * (0.25e0 + 0.75e0 * l.dl / s.avgdl)) AS gain
        FROM {query_bag} AS q JOIN {doc_terms} AS d USING (field, term)
        JOIN {term_stats} AS t USING (field, term) JOIN {field_stats} AS s USING (field)
        JOIN {lengths} AS l USING (field, doc_id)""",
    "scored": """
        SELECT query_id, doc_id, round(max(field_gain * CASE field WHEN 'title' THEN 3e0 ELSE 1e0 END), 6) AS score
        FROM (SELECT query_id, doc_id, field, sum(gain) AS field_gain FROM {gains} GROUP BY ALL) GROUP BY ALL""",
    "placed": """
        SELECT query_id, doc_id, score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank,
               count(*) OVER (PARTITION BY query_id) AS total
        FROM {scored}""",
    # Result rows: hits up to the page's end that have a document.
    "found": f"""
        SELECT p.query_id, p.rank, p.score, p.total, d.id, d.title, d.updated_by, d.updated_on,
               concat('{BASE_URL.rsplit('/', 1)[0]}/', regexp_replace(d.file_name, '\\.[^./]*$', '')) AS url
        FROM {{placed}} AS p JOIN {{asked_pages}} AS a USING (query_id) JOIN {{assembled}} AS d USING (doc_id)
        WHERE p.rank <= (a.page + 1) * 5""",
    "channel_scale": "SELECT unnest([0, 1, 2]) AS c, unnest([65, 105, 225]) AS full_rgb",
    "attached": "SELECT query_id, max(total) AS total, count(*) AS n_rows FROM {found} GROUP BY query_id",
    "reply_rows": """
        SELECT query_id, rank, title, url AS link, concat('changed by ', updated_by) AS footer, color,
               updated_on // 1000000 AS ts
        FROM {colored}""",
    # Passages.
    "first_page": "SELECT query_id, doc_id, rank FROM {placed} WHERE rank <= 5",
    "page_words": f"""
        SELECT doc_id, i - 1 AS pos, ws[i] AS word, lower(ws[i]) AS token
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i
              FROM (SELECT doc_id, {tokens(stripped('text'))} AS ws FROM {{documents}}
                    WHERE doc_id IN (SELECT doc_id FROM {{first_page}})))""",
    "marked": """
        SELECT p.query_id, p.doc_id, w.pos, w.word, s.term
        FROM {first_page} AS p JOIN {page_words} AS w USING (doc_id) JOIN {stems} AS s USING (token)
        WHERE EXISTS (SELECT 1 FROM {query_bag} AS q
                      WHERE q.query_id = p.query_id AND q.field = 'content' AND q.term = s.term)""",
    "grouped": """
        SELECT query_id, doc_id, pos, sum(CASE WHEN gap IS NULL OR gap > 12 THEN 1 ELSE 0 END)
               OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS fragment
        FROM (SELECT *, pos - lag(pos) OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS gap FROM {marked})""",
    "spans": """
        SELECT query_id, doc_id, CAST(fragment AS BIGINT) AS fragment, min(pos) - 6 AS low, max(pos) + 6 AS high
        FROM {grouped} WHERE fragment <= 5 GROUP BY ALL""",
    "passages": """
        SELECT s.query_id, s.doc_id, s.fragment,
               string_agg(CASE WHEN m.pos IS NULL THEN w.word ELSE concat('<em>', w.word, '</em>') END, ' '
                          ORDER BY w.pos) AS passage
        FROM {spans} AS s JOIN {page_words} AS w ON w.doc_id = s.doc_id AND w.pos BETWEEN s.low AND s.high
        LEFT JOIN {marked} AS m ON m.query_id = s.query_id AND m.doc_id = s.doc_id AND m.pos = w.pos
        GROUP BY ALL""",
    # Access.
    "rules": """
        SELECT rule, CASE WHEN rule = '*' THEN 'all' WHEN left(rule, 1) = '@' THEN 'user'
                          WHEN left(rule, 1) = '#' THEN 'channel' ELSE 'invalid' END AS kind,
               CASE WHEN left(rule, 1) IN ('@', '#') THEN substr(rule, 2) ELSE rule END AS name
        FROM {rule_list}""",
    "open_channels": """
        SELECT DISTINCT c.channel_id FROM {chat_channels} AS c JOIN {rules} AS r ON r.name = c.channel_name
        WHERE r.kind = 'channel' AND c.bot_is_member""",
    "open_members": "SELECT DISTINCT user_id FROM {chat_members} WHERE channel_id IN (SELECT channel_id FROM {open_channels})",
    "open_users": """
        SELECT user_id, user_name FROM {chat_users}
        WHERE user_name IN (SELECT name FROM {rules} WHERE kind = 'user')""",
    "talk": """
        SELECT * FROM {chat_messages} WHERE user_id <> 'UBOT'
        AND (subtype IS NULL OR subtype = 'me_message' OR subtype = 'message_changed')""",
    "permitted": """
        SELECT user_id FROM {chat_users} WHERE user_name IS NOT NULL
        AND (user_id IN (SELECT user_id FROM {open_users}) OR user_id IN (SELECT user_id FROM {open_members}))""",
    "authorised": f"""
        SELECT message_id, channel_id, user_id, {all_replaced('text', [('<[^>]*>', "''", 'g'), ('^\\s+|\\s+$', "''", 'g')])} AS text
        FROM {{talk}}
        WHERE (left(channel_id, 1) = 'D'
               OR (regexp_matches(text, '<@UBOT[|>]') AND channel_id IN (SELECT channel_id FROM {{open_channels}})))
          AND user_id IN (SELECT user_id FROM {{permitted}})""",
    "pages_asked": """
        SELECT event_id, list_filter(
            [{'n': first_name, 'v': first_value}, {'n': second_name, 'v': second_value}],
            lambda a: a.n IN ('more', 'less') AND coalesce(regexp_matches(a.v, '^-?[0-9]{1,18}$'), false)) AS usable
        FROM {button_events}""",
}
for _name, _sql in stem_steps("{all_words}", "stems"):
    # Steps name each other plainly; only the words come from elsewhere.
    PARTS[_name] = _sql.replace("FROM stems_", "FROM {stems_").replace(" AS s", "} AS s") if _name != "stems_0" else _sql
PARTS["stems"] = PARTS["stems"].replace("FROM {stems_9", "FROM {stems_9}")


def color(score: str) -> str:
    def linear(channel: int) -> float:
        value = channel / 255
        return ((value + 0.055) / 1.055) ** 2.4

    share = f"least({score} / 10e0, 1e0)"
    signs = []
    for full in (65, 105, 225):
        light = f"({share} * {linear(full)!r}::DOUBLE + (1 - {share}) * {linear(245)!r}::DOUBLE)"
        level = f"CAST(round((1.055e0 * pow({light}, {1 / 2.4!r}::DOUBLE) - 0.055e0) * 255) AS INTEGER)"
        signs.append(f"lower(lpad(to_hex({level}), 2, '0'))")
    return "concat('#', " + ", ".join(signs) + ")"


PARTS["colored"] = f"SELECT *, {color('score')} AS color FROM {{found}}"


def encoded(value: str) -> str:
    return f"replace(replace(replace(url_encode({value}), '+', '%20'), '*', '%2A'), '%7E', '~')"


def quoted(value: str) -> str:
    return f"concat('_', replace(replace(replace(replace({value}, '`', ''), '*', ''), '_', ''), chr(10), ''), '_')"


def new_page(value: str) -> str:
    return f"concat('{BASE_URL.rsplit('/', 1)[0]}/_new?wiki%5Bbody%5D=', {encoded(value)})"


def pager(page: str, total: str) -> str:
    return f"concat('Shown: ', ({page} + 1) * 5, ' of ', {total}, ' hits')"


def buttons(page: str, text: str) -> str:
    """The buttons as JSON, each with its page and query."""
    def button(name: str) -> str:
        return f"{{'name': '{name}', 'value': CAST({page} AS VARCHAR), 'callback': {text}}}"

    return (f"CAST(CASE WHEN {page} > 0 THEN to_json([{button('less')}, {button('more')}])"
            f" ELSE to_json([{button('more')}]) END AS VARCHAR)")


def statement(final: str, **own: str) -> str:
    """The final select with all expressions it needs, each defined once."""
    parts = {**PARTS, **VIEWS, **own}
    ordered: list[str] = []

    def need(sql: str) -> None:
        for name in references(sql):
            if name in parts and name not in ordered:
                need(parts[name])
                ordered.append(name)

    need(final)
    known = set(ordered) | set(TABLES)

    def plain_names(sql: str) -> str:
        for name in references(sql):
            if name in known:
                sql = sql.replace("{" + name + "}", name)
        return sql

    ctes = ",\n".join(f"{name} AS ({plain_names(parts[name])})" for name in ordered)
    return (f"WITH {ctes}\n" if ctes else "") + plain_names(final)


ASKED = {"asked": "SELECT query_id, text FROM {queries}"}
NAMED = {"asked": "SELECT query_id, text FROM {name_queries}"}
NO_QUERIES = {"query_words": "SELECT '' AS token"}
FIRST_PAGE = {"asked_pages": "SELECT query_id, text, 0 AS page FROM {asked}"}
THIRD_PAGES = {"asked_pages": "SELECT query_id, text, query_id % 3 AS page FROM {asked}"}
ONLY_ACCEPTED = {**NO_QUERIES, "titled": "SELECT doc_id, title, content AS text FROM {assembled}"}
MESSAGES = {"asked": "SELECT message_id AS query_id, text FROM {authorised}", **FIRST_PAGE}
EVENTS = {
    "open_events": """
        SELECT event_id AS query_id, kind, user_id, text FROM {chat_events}
        WHERE user_id IN (SELECT user_id FROM {permitted}) AND user_id <> 'UBOT'
          AND (kind IN ('command', 'button')
               OR (kind = 'message' AND (subtype IS NULL OR subtype = 'me_message')
                   AND (left(channel_id, 1) = 'D' OR (regexp_matches(text, '<@UBOT[|>]')
                        AND channel_id IN (SELECT channel_id FROM {open_channels})))))""",
    "asked_pages": f"""
        SELECT e.query_id, e.kind, CASE WHEN e.kind = 'message' THEN concat('<@', e.user_id, '> ') ELSE '' END AS hail,
               CASE WHEN e.kind = 'message' THEN {all_replaced('e.text', [('<[^>]*>', "''", 'g'), ('^\\s+|\\s+$', "''", 'g')])}
                    ELSE e.text END AS text,
               CASE WHEN e.kind <> 'button' THEN 0
                    ELSE CAST(p.usable[1].v AS BIGINT) + CASE p.usable[1].n WHEN 'more' THEN 1 ELSE -1 END END AS page
        FROM {{open_events}} AS e LEFT JOIN {{pages_asked}} AS p ON p.event_id = -1 - e.query_id""",
    "texts": "SELECT text, row_number() OVER (ORDER BY text) AS text_id FROM (SELECT DISTINCT text FROM {asked_pages})",
    "asked": "SELECT text_id AS query_id, text FROM {texts}",
    "found": PARTS["found"].replace("p.query_id, p.rank", "a.query_id, p.rank").replace(
        "JOIN {asked_pages} AS a USING (query_id)",
        "JOIN {texts} AS x ON x.text_id = p.query_id JOIN {asked_pages} AS a ON a.text = x.text"),
}

CHECKS: dict[str, str] = {
    "scan_docs": statement(
        "SELECT doc_id, path FROM {wiki_files} WHERE split_part(path, '.', -1) IN ('md', 'org', 'rst', 'txt')"
    ),
    "filter_hidden": statement(
        "SELECT doc_id, path FROM {wiki_files} WHERE NOT list_bool_or(list_transform(string_split(path, '/'),"
        " lambda p: left(p, 1) IN ('.', '_')))"
    ),
    "relative_path": statement(
        "SELECT doc_id, CASE WHEN lang = 'en' THEN path ELSE concat('/srv/wiki-old/', path) END AS path FROM {wiki_files}"
    ),
    "resolve_stems": statement("SELECT doc_id, path, stem FROM {sources}"),
    "source_format": statement(
        "SELECT doc_id, CASE split_part(path, '.', -1) WHEN 'md' THEN 'gfm' WHEN 'org' THEN 'org' WHEN 'rst' THEN 'rst'"
        " ELSE 'markdown' END AS format, 'markdown' AS compat_format FROM {wiki_files}"
    ),
    "html_to_text": f"SELECT page_id, {plain('html')} AS plain FROM pages",
    "page_toc": f"""
        WITH found AS (
            SELECT page_id, unnest(hs) AS h, unnest(generate_series(1, len(hs))) AS ord
            FROM (SELECT page_id, regexp_extract_all(html, {lit('(?is)' + '|'.join(rf'<h{n}(?:\s[^>]*)?>.*?</h{n}\s*>' for n in range(1, 7)))}) AS hs
                  FROM pages)),
        named AS (
            SELECT page_id, CAST(ord AS BIGINT) AS ord, CAST(substr(h, 3, 1) AS BIGINT) AS level,
                   trim(regexp_replace({plain('h')}, '\\s+', ' ', 'g')) AS heading FROM found)
        SELECT *, regexp_replace(regexp_replace(lower(heading), '[^\\p{{L}}\\p{{N}}\\s_.-]', '', 'g'), '\\s+', '-', 'g') AS anchor
        FROM named""",
    "last_change": statement("SELECT path, authored_at AS updated, author_name, author_email, seq FROM {newest}"),
    "parse_commit_line": statement("""
        SELECT seq, CASE WHEN ok THEN p[1] END AS updated, CASE WHEN ok THEN p[2] END AS author_name,
               CASE WHEN ok THEN p[3] END AS author_email
        FROM (SELECT seq, p, len(p) = 3 AS ok FROM (SELECT seq, string_split(rtrim(line, chr(10)), chr(9)) AS p FROM {commit_lines}))"""),
    "decode_metadata": statement(
        "SELECT path, CAST(authored_at AS VARCHAR) AS updated, author_name, author_email FROM {newest} WHERE author_email IS NOT NULL"
    ),
    "metadata_rejects": statement(
        "SELECT path, 'missing: author_email' AS reason FROM {newest} WHERE author_email IS NULL"
    ),
    "assemble_documents": statement("SELECT * FROM {assembled}"),
    "document_id": statement("SELECT doc_id, sha1(path) AS id FROM {wiki_files}"),
    "title_from_path": statement("SELECT doc_id, title FROM {titled}"),
    "documents_json": statement("""
        SELECT id, CAST(to_json({'id': id, 'content': content, 'html': html, 'file_name': file_name, 'title': title,
                   'updated_by': updated_by, 'updated_on': CAST(updated_on AS VARCHAR)}) AS VARCHAR) AS json,
               title, CAST(updated_on AS VARCHAR) AS updated_on, sha1(content) AS content_digest
        FROM {assembled}"""),
    "parse_updated_on": statement("""
        SELECT e.event_id, CASE e.event_id % 7 WHEN 0 THEN epoch_us(e.ts) - 7200000000 WHEN 1 THEN epoch_us(e.ts)
               WHEN 2 THEN CAST(d.written AS BIGINT) * 1000 WHEN 3 THEN epoch_us(e.ts)
               WHEN 4 THEN epoch_us(date_trunc('month', e.ts)) WHEN 5 THEN epoch_us(date_trunc('year', e.ts))
               ELSE NULL END AS updated_on
        FROM {events} AS e JOIN {date_texts} AS d USING (event_id)"""),
    "changed_documents": statement("""
        SELECT s.path, sha256(s.text) AS hash, CASE WHEN p.path IS NULL THEN 'new' ELSE 'changed' END AS state
        FROM {sources} AS s LEFT JOIN {previous_texts} AS p USING (path)
        WHERE p.path IS NULL OR p.text <> s.text"""),
    "removed_documents": statement(
        "SELECT path FROM {previous_texts} WHERE path NOT IN (SELECT path FROM {sources})"
    ),
    "upsert_documents": statement("""
        SELECT id, content, updated_by, version FROM (
            SELECT sha1(path) AS id, text AS content, 'import' AS updated_by, -1 AS version FROM {wiki_files}
            UNION ALL
            SELECT sha1(path), concat(path, ' as of ', seq), author_name, seq FROM {commits} WHERE author_email IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1"""),
    "rebuild_index": statement("""
        SELECT field, count(DISTINCT doc_id) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_terms, count(*) AS n_postings,
               round(sum(tf) / CAST(count(DISTINCT doc_id) AS DOUBLE), 6) AS avgdl, count(DISTINCT term) AS n_vocabulary
        FROM {doc_terms} GROUP BY field""", **ONLY_ACCEPTED),
    "incremental_build": statement("""
        SELECT 'document' AS fact, id, sha1(content) AS digest, CAST(0 AS BIGINT) AS n FROM {assembled}
        UNION ALL SELECT 'manifest', id, sha1(file_name), 0 FROM {assembled}
        UNION ALL SELECT 'n_docs', field, '', count(DISTINCT doc_id) FROM {doc_terms} GROUP BY field
        UNION ALL SELECT 'n_terms', field, '', CAST(sum(tf) AS BIGINT) FROM {doc_terms} GROUP BY field
        UNION ALL SELECT 'n_postings', field, '', count(*) FROM {doc_terms} GROUP BY field""",
        **ONLY_ACCEPTED, wiki_files=f"SELECT * FROM ({VIEWS['wiki_files']}) AS every WHERE lang <> 'fr'"),
    "clear_index": statement("""
        SELECT 'postings' AS table_name, count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM {doc_terms}
        UNION ALL SELECT 'terms', count(*), 0 FROM (SELECT DISTINCT field, term FROM {doc_terms})
        UNION ALL SELECT 'fields', count(DISTINCT field), 0 FROM {doc_terms}""", **ONLY_ACCEPTED),
    "index_rejects": statement("""
        SELECT sha1(f.path) AS id, CASE WHEN f.lang = 'es' THEN 'missing content' ELSE 'missing date' END AS reason
        FROM {wiki_files} AS f LEFT JOIN {newest} AS n USING (path)
        WHERE f.lang = 'es' OR n.author_email IS NULL"""),
    "html_strip": f"SELECT page_id, {stripped('html')} AS stripped FROM pages",
    "tokenize": f"""
        SELECT token, count(*) AS n FROM (SELECT unnest({tokens('lower(text)')}) AS token FROM documents) GROUP BY token""",
    "tokenize_pages": f"""
        SELECT token, count(*) AS n FROM (SELECT unnest({tokens('lower(' + stripped('html') + ')')}) AS token FROM pages)
        GROUP BY token""",
    "stem_vocabulary": statement(
        "SELECT token, term FROM {stems}", all_words=f"SELECT unnest({tokens('lower(text)')}) AS token FROM documents"
    ),
    "analyze_content": statement(
        "SELECT doc_id, term, tf FROM {doc_terms} WHERE field = 'content'", **NO_QUERIES
    ),
    "analyze_title": statement("SELECT doc_id, term, tf FROM {doc_terms} WHERE field = 'title'", **NO_QUERIES),
    "postings": statement(
        "SELECT field, term, doc_id, tf, dl FROM {doc_terms} JOIN {lengths} USING (field, doc_id)", **NO_QUERIES
    ),
    "doc_lengths": statement("SELECT field, doc_id, dl FROM {lengths}", **NO_QUERIES),
    "corpus_stats": statement(
        "SELECT field, term, df, cf, n_docs, round(avgdl, 6) AS avgdl FROM {term_stats} JOIN {field_stats} USING (field)",
        **NO_QUERIES,
    ),
    "update_index": statement(
        "SELECT field, term, df, cf, n_docs, round(avgdl, 6) AS avgdl FROM {term_stats} JOIN {field_stats} USING (field)",
        **NO_QUERIES,
        titled=PARTS["titled"].replace("SELECT *", "SELECT * REPLACE (CASE WHEN lang = 'de'"
                                       " THEN concat(text, ' revised draft') ELSE text END AS text)"),
    ),
    "query_terms": statement("SELECT query_id, field, term, qtf FROM {query_bag}", **ASKED),
    "match_docs": statement(
        "SELECT query_id, doc_id, count(*) AS matched_terms FROM {query_bag} JOIN {doc_terms} USING (field, term) GROUP BY ALL",
        **ASKED,
    ),
    "bm25_scores": statement(
        "SELECT query_id, doc_id, field, round(sum(gain), 6) AS score FROM {gains} GROUP BY ALL", **ASKED
    ),
    "search_ranked": statement("SELECT query_id, doc_id, score FROM {scored}", **ASKED),
    "search_totals": statement("SELECT query_id, count(*) AS total FROM {scored} GROUP BY ALL", **NAMED),
    "search_page": statement("""
        SELECT query_id, rank, doc_id, score, total FROM {placed}
        WHERE rank > query_id % 4 * 5 AND rank <= query_id % 4 * 5 + query_id % 4 + 3""", **ASKED),
    "highlight_terms": statement(
        "SELECT query_id, doc_id, CAST(pos AS BIGINT) AS pos, word, term FROM {marked}", **ASKED
    ),
    "highlight": statement("SELECT * FROM {passages}", **ASKED),
    "highlight_markup": statement("""
        SELECT p.query_id, p.doc_id,
               concat(string_agg(replace(replace(passage, '<em>', '*'), '</em>', '*'), chr(10) ORDER BY fragment)) || chr(10) AS highlight
        FROM {first_page} AS p LEFT JOIN {passages} USING (query_id, doc_id) GROUP BY ALL""", **ASKED),
    "document_url": statement(f"""
        SELECT doc_id, CASE WHEN regexp_matches(file_name, '[^\\x21-\\x7e]') OR split_part(file_name, '/', 1) LIKE '%:%'
                            THEN '{BASE_URL}'
                            ELSE concat('{BASE_URL.rsplit('/', 1)[0]}/', regexp_replace(file_name, '\\.[^./]*$', '')) END AS url
        FROM {{file_names}}"""),
    "search_results": statement(
        "SELECT query_id, rank, id, title, url, updated_by, updated_on, score, total FROM {found}", **NAMED, **FIRST_PAGE
    ),
    "search_highlights": statement("""
        SELECT p.query_id, p.rank, d.id,
               concat(string_agg(replace(replace(h.passage, '<em>', '*'), '</em>', '*'), chr(10) ORDER BY h.fragment)) || chr(10) AS highlight
        FROM {first_page} AS p JOIN {assembled} AS d USING (doc_id) LEFT JOIN {passages} AS h USING (query_id, doc_id)
        GROUP BY p.query_id, p.rank, d.id""", **ASKED),
    "search_status": statement("""
        SELECT query_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'bad_query'
                              WHEN query_id IN (SELECT query_id FROM {scored}) THEN 'ok' ELSE 'empty' END AS status
        FROM {asked}""", asked="SELECT query_id, text FROM {odd_queries}"),
    "route_events": statement("""
        SELECT event_id, kind, channel_id, ts, user_id, subtype, text, first_name, first_value, second_name, second_value, CASE WHEN kind IN ('message', 'command', 'button') THEN kind ELSE 'ignore' END AS route
        FROM {chat_events}"""),
    "eligible_messages": statement("SELECT message_id, user_id, subtype FROM {talk}"),
    "is_dm": statement("SELECT message_id, left(channel_id, 1) = 'D' AS is_dm FROM {chat_messages}"),
    "is_mentioned": statement(
        "SELECT message_id, regexp_matches(text, '<@UBOT[|>]') AS is_mentioned FROM {chat_messages}"
    ),
    "message_query_text": statement(f"""
        SELECT message_id, {all_replaced('text', [('<[^>]*>', "''", 'g'), ('^\\s+|\\s+$', "''", 'g')])} AS query_text
        FROM {{chat_messages}}"""),
    "allow_rules": statement("SELECT rule, kind, name FROM {rules}"),
    "allowed_channels": statement("SELECT channel_id FROM {open_channels}"),
    "allowed_members": statement("SELECT user_id FROM {open_members}"),
    "allowed_users": statement("SELECT user_id, user_name FROM {open_users}"),
    "authorized_messages": statement("SELECT message_id, channel_id, user_id, text FROM {authorised}"),
    "authorized_messages_everyone": statement(
        "SELECT message_id, channel_id, user_id, text FROM {authorised}", rule_list="SELECT '*' AS rule",
        permitted="SELECT user_id FROM {chat_users} WHERE user_name IS NOT NULL",
    ),
    "authorized_commands": statement(f"""
        SELECT command_id, user_id IN (SELECT user_id FROM {{permitted}}) AS allowed,
               CASE WHEN user_id NOT IN (SELECT user_id FROM {{permitted}}) THEN {lit(access.REFUSAL)} END AS reply
        FROM {{commands}}"""),
    "authorized_buttons": statement(
        "SELECT event_id, user_id FROM {button_events} WHERE user_id IN (SELECT user_id FROM {permitted})"
    ),
    "button_pages": statement(f"""
        SELECT event_id, CAST(usable[1].v AS BIGINT) + CASE usable[1].n WHEN 'more' THEN 1 ELSE -1 END AS page,
               CASE WHEN len(usable) = 0 THEN {lit(reply.CONFUSED)} END AS reply
        FROM {{pages_asked}}"""),
    "reply_pages": statement("""
        SELECT query_id, a.page, rank, doc_id, total FROM {placed} JOIN {asked_pages} AS a USING (query_id)
        WHERE rank <= (a.page + 1) * 5""", **ASKED, **THIRD_PAGES),
    "reply_headers": statement(f"""
        SELECT query_id, concat(CASE WHEN query_id % 2 = 0 THEN concat('<@U', query_id, '> ') ELSE '' END,
               CASE WHEN total IS NULL THEN concat('Nothing is known about ', {quoted('text')})
                    ELSE concat(total, ' hits for ', {quoted('text')}) END) AS reply
        FROM {{asked}} LEFT JOIN (SELECT query_id, count(*) AS total FROM {{scored}} GROUP BY ALL) USING (query_id)""", **NAMED),
    "deep_page": statement("SELECT query_id, rank, doc_id, total FROM {placed}", **ASKED),
    "reply_attachments": statement("SELECT * FROM {reply_rows}", **ASKED, **THIRD_PAGES),
    "reply_pager": statement(f"""
        SELECT query_id, page, {pager('page', 'total')} AS pager, {buttons('page', 'text')} AS buttons
        FROM {{attached}} JOIN {{asked_pages}} USING (query_id) WHERE n_rows < total""", **ASKED, **THIRD_PAGES),
    "no_hit_links": statement(f"""
        SELECT query_id, concat('Nothing is known about ', {quoted('text')}) AS reply, {new_page('text')} AS link
        FROM {{asked}} WHERE query_id NOT IN (SELECT query_id FROM {{found}})""", **NAMED, **FIRST_PAGE),
    "quote_query": statement(f"SELECT message_id, {quoted('text')} AS quoted FROM {{chat_messages}}"),
    "score_color": f"SELECT event_id, {color('(value / 5)')} AS color FROM events",
}
CHECKS["message_replies"] = statement(f"""
    SELECT message_id,
           CASE WHEN trim(a.text) = '' THEN {lit(reply.FAILURE)}
                ELSE concat('<@', a.user_id, '> ',
                     CASE WHEN n_rows IS NULL THEN concat('Nothing is known about ', {quoted('a.text')})
                          ELSE concat(total, ' hits for ', {quoted('a.text')}) END) END AS reply,
           CASE WHEN trim(a.text) <> '' THEN coalesce(n_rows, 0) END AS n_rows,
           CASE WHEN trim(a.text) <> '' AND n_rows < total THEN {pager('0', 'total')} END AS pager,
           CASE WHEN trim(a.text) <> '' AND n_rows < total THEN {buttons('0', 'a.text')} END AS buttons,
           CASE WHEN trim(a.text) <> '' AND n_rows IS NULL THEN {new_page('a.text')} END AS new_page
    FROM {{authorised}} AS a LEFT JOIN {{attached}} AS t ON t.query_id = a.message_id""", **MESSAGES)
CHECKS["event_replies"] = CHECKS["stream_replies"] = statement(f"""
    SELECT a.query_id AS event_id,
           CASE WHEN page IS NULL THEN {lit(reply.CONFUSED)}
                WHEN trim(text) = '' OR page < -1 THEN {lit(reply.FAILURE)}
                ELSE concat(hail, CASE WHEN n_rows IS NULL THEN concat('Nothing is known about ', {quoted('text')})
                                       ELSE concat(total, ' hits for ', {quoted('text')}) END) END AS reply,
           CASE WHEN trim(text) <> '' AND page >= -1 THEN coalesce(n_rows, 0) END AS n_rows,
           CASE WHEN n_rows < total THEN {pager('page', 'total')} END AS pager,
           CASE WHEN n_rows < total THEN {buttons('page', 'text')} END AS buttons,
           CASE WHEN trim(text) <> '' AND page >= -1 AND n_rows IS NULL THEN {new_page('text')} END AS new_page,
           e.channel_id, e.ts
    FROM {{asked_pages}} AS a LEFT JOIN {{attached}} AS t USING (query_id)
    JOIN (SELECT event_id, channel_id, ts FROM {{chat_events}}) AS e ON e.event_id = a.query_id
    UNION ALL
    SELECT event_id, {lit(access.REFUSAL)}, NULL, NULL, NULL, NULL, channel_id, ts FROM {{chat_events}}
    WHERE kind = 'command' AND event_id NOT IN (SELECT query_id FROM {{open_events}})""", **EVENTS)
CHECKS["event_reply_rows"] = statement(
    "SELECT query_id AS event_id, rank, title, link, footer, color, ts FROM {reply_rows}", **EVENTS
)
CHECKS["stream_library"] = CHECKS["incremental_build"]

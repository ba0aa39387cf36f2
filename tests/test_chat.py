import pytest
from pyspark.sql import functions as F

from lorekeep.functions.colors import score_color
from lorekeep.functions.urls import encode_query_value, new_page_url
from lorekeep.operators import access, reply

USERS = {"U1": "ann", "U2": "bob", "U3": None, "UBOT": "bot", "U4": "cy"}
CHANNELS = {"C1": ("open", True), "C2": ("open", True), "C3": ("away", False), "C4": ("shut", True)}
MEMBERS = [("C2", "U2"), ("C3", "U4"), ("C4", "U4"), ("C1", "U3")]


@pytest.fixture(scope="module")
def chat(spark):
    users = spark.createDataFrame(list(USERS.items()), "user_id string, user_name string")
    channels = spark.createDataFrame(
        [(c, n, b) for c, (n, b) in CHANNELS.items()], "channel_id string, channel_name string, bot_is_member boolean"
    )
    return users, channels, spark.createDataFrame(MEMBERS, "channel_id string, user_id string")


def rule_list(spark, *rules):
    return access.parse_rules(spark.createDataFrame([(r,) for r in rules], "rule string"))


def messages(spark):
    rows = [
        (i, channel, user, subtype, text)
        for i, (channel, user, subtype, text) in enumerate(
            (c, u, s, t)
            for c in ("D1", "C1", "C3", "C4")
            for u in ("U1", "U2", "U3", "U4", "U9", "UBOT")
            for s in (None, "me_message", "message_changed", "bot_message")
            for t in ("hello", "<@UBOT> hello", "<@UBOT|bot>  hello <http://x> ", "<@UBOTS> no")
        )
    ]
    return rows, spark.createDataFrame(rows, "message_id long, channel_id string, user_id string, subtype string, text string")


def plain_decision(rules, row):
    _, channel, user, subtype, text = row
    everyone = rules in ((), ("*",))
    open_channels = {c for c, (n, member) in CHANNELS.items() if member and "#" + n in rules}
    if user == "UBOT" or subtype == "bot_message":
        return False
    mentioned = "<@UBOT>" in text or "<@UBOT|" in text
    if not (channel.startswith("D") or (mentioned and channel in open_channels)):
        return False
    if USERS.get(user) is None:
        return False
    return everyone or "@" + USERS[user] in rules or any(c in open_channels and u == user for c, u in MEMBERS)


@pytest.mark.parametrize("rules", [("*",), (), ("@ann",), ("#open",), ("#open", "@cy", "#away", "nonsense", "#none")])
def test_decisions_match_the_plain_rules(spark, chat, rules):
    rows, df = messages(spark)
    got = access.authorise_messages(df, rule_list(spark, *rules), *chat, "UBOT").collect()
    assert sorted(r.message_id for r in got) == [row[0] for row in rows if plain_decision(rules, row)]
    assert {r.text for r in got} <= {"hello", "no"}


def test_everyone_is_not_answered_in_channels(spark, chat):
    for rules in (rule_list(spark, "*"), rule_list(spark, "*", "#open")):
        got = access.authorise_messages(messages(spark)[1], rules, *chat, "UBOT")
        assert {r.channel_id for r in got.collect()} == {"D1"}


def test_requests_do_not_ask_for_the_channel(spark, chat):
    rows = [(i, c, u) for i, (c, u) in enumerate([("C4", "U1"), ("", "U2"), ("C1", "U4"), ("C1", "U9"), ("C1", "UBOT")])]
    df = spark.createDataFrame(rows, "command_id long, channel_id string, user_id string")
    decided = access.refusals(access.authorise_requests(df, rule_list(spark, "@ann", "#open", "@bot"), *chat, "UBOT"))
    got = {r.command_id: (r.allowed, r.reply) for r in decided.collect()}
    assert got == {
        0: (True, None), 1: (True, None), 2: (False, access.REFUSAL), 3: (False, access.REFUSAL), 4: (False, access.REFUSAL)
    }


def test_rules_and_channels(spark, chat):
    rules = rule_list(spark, "*", "@a", "#c", "x", "")
    assert [(r.kind, r.name) for r in rules.collect()] == [
        ("all", "*"), ("user", "a"), ("channel", "c"), ("invalid", "x"), ("invalid", "")
    ]
    got = access.allowed_channels(rule_list(spark, "#open", "#away", "#none"), chat[1]).collect()
    assert {r.channel_id for r in got} == {"C1", "C2"}
    listed = spark.createDataFrame([("C1", ["U1", "U2"]), ("C2", None)], "channel_id string, members array<string>")
    assert {(r.channel_id, r.user_id) for r in access.members_of(listed).collect()} == {("C1", "U1"), ("C1", "U2")}


def test_routes(values):
    kinds = ["message", "command", "button", "hello", "hidden_message", None]
    assert values(access.route, kinds) == ["message", "command", "button", "ignore", "ignore", "ignore"]


def test_button_pages(spark):
    cases = [
        ([("more", "0")], 1), ([("less", "3")], 2), ([("x", "1"), ("more", "y"), ("less", "1"), ("more", "5")], 0),
        ([("more", None)], None), ([], None), ([("more", "1.5")], None), ([("less", "0")], -1), (None, None),
    ]
    schema = "i int, actions array<struct<name: string, value: string>>"
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], schema)
    got = df.select("i", reply.new_page_value(F.col("actions")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [p for _, p in cases]


def result_rows(spark, n, total):
    rows = [(1, i, f"t{i}", f"u{i}", "me", 1704067200, float(i), total) for i in range(n, 0, -1)]
    return spark.createDataFrame(
        rows, "query_id long, rank long, title string, url string, updated_by string, s long, score double, total long"
    ).withColumn("updated_on", F.timestamp_seconds("s"))


@pytest.mark.parametrize(
    "page, n, total, pager, buttons",
    [
        (0, 5, 12, "Shown: 5 of 12 hits", ["more"]),
        (1, 10, 12, "Shown: 10 of 12 hits", ["less", "more"]),
        (2, 12, 12, None, None),
        (0, 5, 5, None, None),
        (0, 4, 5, "Shown: 5 of 5 hits", ["more"]),
        (2400, 12_000, 13_000, "Shown: 12005 of 13000 hits", ["less", "more"]),
    ],
)
def test_replies_with_hits(spark, page, n, total, pager, buttons):
    queries = spark.createDataFrame([(1, "a_*b`\nc", page, "U1")], "query_id long, text string, page int, user_id string")
    results = result_rows(spark, n, total)
    got = reply.replies(queries, results, "http://h/w/home").first()
    assert got.reply == f"<@U1> {total} hits for _abc_"
    assert (got.n_rows, got.pager, got.new_page) == (n, pager, None)
    assert [(b.name, b.value, b.callback) for b in got.buttons or []] == [(b, str(page), "a_*b`\nc") for b in buttons or []]
    rows = reply.result_rows(results).orderBy("rank").collect()
    assert [r.title for r in rows] == [f"t{i}" for i in range(1, n + 1)]
    assert tuple(rows[0]) == (1, 1, "t1", "u1", "changed by me", rows[0].color, 1704067200)


def test_a_button_brings_the_next_page(spark):
    queries = spark.createDataFrame([(1, "q", 1, None)], "query_id long, text string, page int, user_id string")
    head = reply.replies(queries, result_rows(spark, 10, 30), "http://h/w/home")
    pressed = head.select(F.explode("buttons").alias("b")).select(
        F.array(F.struct("b.name", "b.value")).alias("actions"), F.col("b.callback").alias("text")
    )
    got = pressed.select(reply.new_page_value(F.col("actions")).alias("page"), "text").collect()
    assert sorted(tuple(r) for r in got) == [(0, "q"), (2, "q")]


def test_replies_without_hits_and_failures(spark):
    rows = [(2, "what is é", 0, None), (3, " ", 0, "U1"), (4, None, 0, "U1"), (5, "x", -2, None), (6, "x", -1, None), (7, "x", 2000, None)]
    queries = spark.createDataFrame(rows, "query_id long, text string, page int, user_id string")
    got = {r.query_id: r for r in reply.replies(queries, result_rows(spark, 1, 1), "http://h/w/home").collect()}
    assert got[2].reply == "Nothing is known about _what is é_"
    assert got[2].new_page == "http://h/w/_new?wiki%5Bbody%5D=what%20is%20%C3%A9"
    assert all(got[i].reply == reply.FAILURE and got[i].new_page is None for i in (3, 4, 5))
    assert all(got[i].reply == "Nothing is known about _x_" for i in (6, 7))


def test_query_values(values):
    assert values(encode_query_value, ["a b+c*d~e-f._&=é/"]) == ["a%20b%2Bc%2Ad~e-f._%26%3D%C3%A9%2F"]
    assert values(lambda q: new_page_url("http://h", q), ["x"]) == ["http://h/_new?wiki%5Bbody%5D=x"]


def test_colors(values):
    build = lambda v: score_color(v.cast("double"))
    assert values(build, ["0", "10", "99", None]) == ["#f5f5f5", "#4169e1", "#4169e1", None]

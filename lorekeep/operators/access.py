"""Who is answered: routing of chat events and the allow-list decision.

The decision depends on the sender, so it is taken once per user, on unique
keys; messages then meet the permitted users in one semi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.joins import broadcast_if_small, written

# Message subtypes that are ordinary talk (none at all is, too).
TALK_SUBTYPES = ["me_message", "message_changed"]

REFUSAL = "Sorry, answers are not open to you here."


def route(kind: Column) -> Column:
    """Which branch takes an event; greetings, edits and the rest take none."""
    return F.when(kind.isin("message", "command", "button"), kind).otherwise("ignore")


def is_from_other(user_id: Column, self_id: str) -> Column:
    return user_id != self_id


def is_talk(subtype: Column) -> Column:
    return subtype.isNull() | subtype.isin(TALK_SUBTYPES)


def is_direct(channel_id: Column) -> Column:
    return channel_id.startswith("D")


def is_mentioned(text: Column, self_id: str) -> Column:
    return text.contains(f"<@{self_id}>") | text.contains(f"<@{self_id}|")


def query_text(text: Column) -> Column:
    """The message without mentions, links and other markup."""
    return F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"^\s+|\s+$", "")


def eligible(messages: DataFrame, self_id: str) -> DataFrame:
    return messages.filter(is_from_other(F.col("user_id"), self_id) & is_talk(F.col("subtype")))


def parse_rules(rules: DataFrame) -> DataFrame:
    """``*``, ``@user`` and ``#channel`` as kind and name; others are invalid."""
    sign = F.substring("rule", 1, 1)
    kind = (
        F.when(F.col("rule") == "*", "all").when(sign == "@", "user").when(sign == "#", "channel").otherwise("invalid")
    )
    name = F.when(kind.isin("user", "channel"), F.substr("rule", F.lit(2))).otherwise(F.col("rule"))
    return rules.select("rule", kind.alias("kind"), name.alias("name"))


def answers_everyone(rules: DataFrame) -> bool:
    """Whether the list says everyone: the star, or no rule at all."""
    kinds = {row[0] for row in rules.select("kind").distinct().collect()}  # four at most
    return not kinds or "all" in kinds


def _rule_names(rules: DataFrame, kind: str) -> DataFrame:
    return rules.filter(F.col("kind") == kind).select("name").distinct()


def allowed_channels(rules: DataFrame, channels: DataFrame) -> DataFrame:
    """Ids of listed channels the bot is in; none when everyone is answered.

    A name may belong to several channels, an unknown one to none.  A rule for
    everyone beside named channels does not open these.
    """
    if answers_everyone(rules):
        return channels.limit(0).select("channel_id")
    names = _rule_names(rules, "channel").withColumnRenamed("name", "channel_name")
    return channels.filter("bot_is_member").join(names, "channel_name", "left_semi").select("channel_id").distinct()


def allowed_members(open_channels: DataFrame, members: DataFrame) -> DataFrame:
    """Users in any of the allowed channels."""
    return members.join(broadcast_if_small(open_channels), "channel_id", "left_semi").select("user_id").distinct()


def members_of(channels: DataFrame) -> DataFrame:
    """One row per channel and member; a channel without a list has no members."""
    return channels.select("channel_id", F.explode("members").alias("user_id"))


def allowed_users(rules: DataFrame, users: DataFrame) -> DataFrame:
    """Known users allowed by name."""
    known = users.filter(F.col("user_name").isNotNull())
    if answers_everyone(rules):
        return known.select("user_id", "user_name")
    names = _rule_names(rules, "user").withColumnRenamed("name", "user_name")
    return known.join(names, "user_name", "left_semi").select("user_id", "user_name")


def permitted_users(rules: DataFrame, users: DataFrame, open_channels: DataFrame, members: DataFrame) -> DataFrame:
    """Known users who are allowed by name or as members of an allowed channel."""
    by_name = allowed_users(rules, users).select("user_id")
    known = users.filter(F.col("user_name").isNotNull()).select("user_id")
    by_channel = known.join(allowed_members(open_channels, members), "user_id", "left_semi")
    return by_name.unionByName(by_channel).distinct()


def decide(
    events: DataFrame,
    rules: DataFrame,
    users: DataFrame,
    channels: DataFrame,
    members: DataFrame,
    self_id: str,
) -> DataFrame:
    """Routed events with an ``allowed`` flag, by rules and people as they are now."""
    open_channels = written(allowed_channels(rules, channels))
    return decide_by(events, open_channels, written(permitted_users(rules, users, open_channels, members)), self_id)


def decide_by(events: DataFrame, open_channels: DataFrame, permitted: DataFrame, self_id: str) -> DataFrame:
    """Routed events with an ``allowed`` flag, by open channels and permitted users.

    The sender must be another, permitted user.  A message must be ordinary talk
    and either direct or a mention in an allowed channel; commands and button
    presses may come from anywhere.  Under a rule for everyone no channel is an
    allowed one, so of the messages only direct ones are answered then.
    """
    heard = F.coalesce(F.col("heard"), F.lit(False))
    addressed = (
        F.col("route").isin("command", "button")
        | is_direct(F.col("channel_id"))
        | (is_mentioned(F.col("text"), self_id) & heard)
    )
    proper = is_from_other(F.col("user_id"), self_id) & is_talk(F.col("subtype")) & addressed
    return (
        events.join(broadcast_if_small(open_channels.withColumn("heard", F.lit(True))), "channel_id", "left")
        .join(broadcast_if_small(permitted.withColumn("permitted", F.lit(True))), "user_id", "left")
        .select(*events.columns, F.coalesce(proper & F.col("permitted"), F.lit(False)).alias("allowed"))
    )


def authorise_messages(
    messages: DataFrame,
    rules: DataFrame,
    users: DataFrame,
    channels: DataFrame,
    members: DataFrame,
    self_id: str,
) -> DataFrame:
    """Messages to answer, with the text to search for."""
    routed = eligible(messages, self_id).withColumn("route", F.lit("message"))
    return decide(routed, rules, users, channels, members, self_id).filter("allowed").select(
        "message_id", "channel_id", "user_id", query_text(F.col("text")).alias("text")
    )


def authorise_requests(
    requests: DataFrame,
    rules: DataFrame,
    users: DataFrame,
    channels: DataFrame,
    members: DataFrame,
    self_id: str,
) -> DataFrame:
    """Commands or button presses with an ``allowed`` flag; their channel is not asked."""
    shaped = requests.select(
        *[F.col(c) for c in requests.columns if c not in ("channel_id", "subtype", "text", "route")],
        F.lit("").alias("channel_id"), F.lit(None).cast("string").alias("subtype"), F.lit("").alias("text"),
        F.lit("command").alias("route"),
    )
    decided = decide(shaped, rules, users, channels, members, self_id)
    return decided.drop("channel_id", "subtype", "text", "route")


def refusals(commands: DataFrame) -> DataFrame:
    """Refused commands are told so; refused buttons would stay silent."""
    return commands.withColumn("reply", F.when(~F.col("allowed"), F.lit(REFUSAL)))

"""Ready-made views over leagues, fixtures, teams and owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sides(fixtures: DataFrame) -> DataFrame:
    """Two rows for each fixture, one for each team: (id, team, opponent, scored, conceded, status, match_date)."""
    home = fixtures.select("id", F.col("home").alias("team"), F.col("away").alias("opponent"), F.col("home_goals").alias("scored"), F.col("away_goals").alias("conceded"), "status", "match_date")
    away = fixtures.select("id", F.col("away").alias("team"), F.col("home").alias("opponent"), F.col("away_goals").alias("scored"), F.col("home_goals").alias("conceded"), "status", "match_date")
    return home.unionByName(away)


def league_table(members: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(team, place, played, won, drawn, lost, gf, ga, gd, points, position) of every member (team, place); completed fixtures count."""
    s = sides(fixtures).where("status = 'completed'")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    won, drawn = F.col("scored") > F.col("conceded"), F.col("scored") == F.col("conceded")
    sums = s.groupBy("team").agg(F.count("*").alias("played"), count(won).alias("won"), count(drawn).alias("drawn"), count(F.col("scored") < F.col("conceded")).alias("lost"), F.sum("scored").alias("gf"), F.sum("conceded").alias("ga"))
    rows = members.join(sums, "team", "left").na.fill(0, ["played", "won", "drawn", "lost", "gf", "ga"])
    rows = rows.withColumn("gd", F.col("gf") - F.col("ga")).withColumn("points", 3 * F.col("won") + F.col("drawn"))
    # a league's members are a short list
    order = Window.orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), "place")
    return rows.withColumn("position", F.row_number().over(order))


def fixture_status(fixtures: DataFrame) -> DataFrame:
    return fixtures.groupBy("status").agg(F.count("*").alias("n"))


def open_fixtures(fixtures: DataFrame, n: int = 20) -> DataFrame:
    return fixtures.where("status <> 'completed'").orderBy("match_date", "id").limit(n)


def recent_matches(fixtures: DataFrame, n: int = 8) -> DataFrame:
    """The last ``n`` matches of each team, home or away."""
    r = F.row_number().over(Window.partitionBy("team").orderBy(F.desc("match_date"), F.desc("id")))
    return sides(fixtures).withColumn("r", r).where(F.col("r") <= n)


def with_names(fixtures: DataFrame, teams: DataFrame) -> DataFrame:
    home = teams.select(F.col("team").alias("home"), F.col("name").alias("home_name"))
    away = teams.select(F.col("team").alias("away"), F.col("name").alias("away_name"))
    return fixtures.join(home, "home", "left").join(away, "away", "left")


def find_team(teams: DataFrame, owners: DataFrame, q: str, each: int = 10, limit: int = 15) -> DataFrame:
    """Teams by id, by name and by owner's name (``each`` at most of a kind), first seen first."""
    named = F.lower("name").contains(q.lower())
    kinds = [
        teams.where(F.col("team").cast("string") == q),
        teams.where(named),
        teams.join(owners.where(named).select(F.col("owner")), "owner", "left_semi"),
    ]
    rows = None
    for i, k in enumerate(kinds):
        part = k.orderBy("team").limit(each).select("team", "name", F.lit(i).alias("ord"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("team", "name").agg(F.min("ord").alias("ord")).orderBy("ord", "team").limit(limit)


def team_leagues(leagues: DataFrame) -> DataFrame:
    """(team, id, name, started_at): one row for each team of each league (id, name, team_ids, started_at)."""
    return leagues.select(F.explode(F.array_distinct("team_ids")).alias("team"), "id", "name", "started_at")


def latest_league(leagues: DataFrame) -> DataFrame:
    """The league that each team started last; of equal times that of the largest id."""
    r = F.row_number().over(Window.partitionBy("team").orderBy(F.desc_nulls_last("started_at"), F.desc("id")))
    return team_leagues(leagues).withColumn("r", r).where("r = 1").drop("r")


def match_detail(fixtures: DataFrame, teams: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Fixtures with both teams' names and the engine's input (fixture, engine_version, seed), where one was kept: the newest version's."""
    kept = snapshots.groupBy("fixture").agg(F.max(F.struct("engine_version", "seed")).alias("s"))
    return with_names(fixtures, teams).join(kept, fixtures["id"] == kept["fixture"], "left").select("id", "home", "away", "home_name", "away_name", "home_goals", "away_goals", "status", "match_date", F.col("s.engine_version").alias("engine_version"), F.col("s.seed").alias("seed"))


def team_card(teams: DataFrame, owners: DataFrame, tables: DataFrame) -> DataFrame:
    """A team with its owner and league row; either may be missing."""
    return teams.join(owners.select("owner", F.col("name").alias("owner_name")), "owner", "left").join(tables.select("team", "points", "position"), "team", "left").select("team", "name", "owner_name", "points", "position")

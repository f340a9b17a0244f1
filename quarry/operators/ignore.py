"""Ignore lists as data: rules are rows, and paths are matched with the lists of the folders on their way.

Within a list the last rule that matches decides, and a rule that begins with ! takes a path back. A path is ignored if
any list ignores it or a folder on its way: what lies below an ignored folder can't be taken back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _regex(glob: Column) -> Column:
    """A pattern of names as a regular expression. Marks stand for wild cards while the rest is escaped."""
    marks = (("\\*\\*/", "\x01"), ("/\\*\\*$", "\x02"), ("\\*+", "\x03"), ("\\?", "\x04"), (r"\[!", "\x05"), (r"\[", "\x06"), (r"\]", "\x07"))
    text = glob
    for pattern, mark in marks:
        text = F.regexp_replace(text, pattern, mark)
    text = F.regexp_replace(text, r"\\(.)", "$1")
    text = F.regexp_replace(text, r"([\\.^$|(){}+])", r"\\$1")
    for mark, means in (("\x01", "(?:.*/)?"), ("\x02", "/.+"), ("\x03", "[^/]*"), ("\x04", "[^/]"), ("\x05", "[^"), ("\x06", "["), ("\x07", "]")):
        text = F.replace(text, F.lit(mark), F.lit(means))
    return text


def parse_lists(lists: DataFrame) -> DataFrame:
    """lists: project_id, folder ('' for the root), content. project_id, folder, rules: of each list what its lines say, in
    order; blank lines and comments say nothing. A rule with a slash before its end counts from the list's folder, others
    for names at any depth; one that ends in a slash matches folders alone."""
    line = F.regexp_replace(F.col("line"), r"(?<!\\)[ \t\r]+$", "")
    lines = lists.select("project_id", "folder", F.posexplode(F.split("content", "\n")).alias("at", "line")).select("project_id", "folder", "at", line.alias("line"))
    lines = lines.where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    negated = F.startswith("line", F.lit("!"))
    body = F.when(negated, F.substr("line", F.lit(2))).otherwise(F.col("line"))
    rules = lines.select("project_id", "folder", "at", negated.alias("negated"), F.endswith(body, F.lit("/")).alias("folders_only"), F.regexp_replace(body, "/+$", "").alias("body"))
    anchored = F.contains("body", F.lit("/"))
    regex = F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), _regex(F.regexp_replace("body", "^/", "")), F.lit("$"))
    rows = rules.where("body <> ''").select("project_id", "folder", F.struct("at", regex.alias("regex"), "negated", "folders_only").alias("rule"))
    return rows.groupBy("project_id", "folder").agg(F.array_sort(F.collect_list("rule")).alias("rules"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (project_id, file_path) with ``ignored``; rules as ``parse_lists`` gives them.

    Folders are judged once for all files below them. Each folder or file meets the lists of the folders above it by an
    equality join, a list being one row."""
    parts = F.split("file_path", "/")
    steps = paths.select("project_id", "file_path").distinct().select("project_id", "file_path", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    steps = steps.select("project_id", "file_path", F.slice("parts", F.lit(1), F.col("k")).alias("step"), (F.col("k") < F.size("parts")).alias("is_folder"))
    judged = steps.select("project_id", "step", "is_folder").distinct()
    above = judged.select("*", F.explode(F.sequence(F.lit(0), F.size("step") - 1)).alias("j"))
    above = above.select("project_id", "step", "is_folder", F.array_join(F.slice("step", F.lit(1), F.col("j")), "/").alias("folder"), F.array_join(F.slice("step", F.col("j") + 1, F.size("step") - F.col("j")), "/").alias("rest"))
    met = above.join(rules, ["project_id", "folder"])

    def decide(so_far: Column, rule: Column) -> Column:
        hit = (F.col("is_folder") | ~rule["folders_only"]) & F.regexp("rest", rule["regex"])
        return F.when(hit, ~rule["negated"]).otherwise(so_far)

    out = met.where(F.aggregate("rules", F.lit(False), decide)).select("project_id", "step", "is_folder").distinct()
    left_out = steps.join(out, ["project_id", "step", "is_folder"], "left_semi").select("project_id", "file_path").distinct().withColumn("ignored", F.lit(True))
    return paths.join(left_out, ["project_id", "file_path"], "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))

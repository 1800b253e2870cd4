"""Code trees: which files count, whether they compile and how they start."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slipway import constants as C
from slipway.functions import text as X


def _is_checked() -> Column:
    in_tree = X.code_suffix(F.col("rel_path")).isin(*C.CODE_SUFFIXES) & ~X.has_part(
        F.col("rel_path"), C.SKIP_DIRS
    )
    single = F.col("entry_file")
    return F.when(single.isNull(), in_tree).otherwise(F.col("rel_path") == single)


def select_code_files(code_files: DataFrame) -> DataFrame:
    """Files to check: code outside skipped folders, or the one file of a single-file project."""
    return code_files.filter(_is_checked())


def select_bundle_files(code_files: DataFrame) -> DataFrame:
    """Files to ship; a single-file project also ships the requirements.txt beside it."""
    single = F.col("entry_file")
    belongs = single.isNull() | F.col("rel_path").isin(single, F.lit("requirements.txt"))
    return code_files.filter(belongs & X.is_bundled(F.col("rel_path")))


def _syntax_error(path: Column, source: Column) -> Column:
    """The parser's complaint about a Python source, null if it has none.

    The function travels to the workers by value, so they need not have this package.
    """

    def problem(path: str, source: str | None) -> str | None:
        if source is None:
            return None
        try:
            compile(source, path, "exec", dont_inherit=True)
        except Exception as error:  # a bad file is a result here, whatever the parser raises
            return f"{path}: {error}"
        return None

    def problems(paths: pd.Series, sources: pd.Series) -> pd.Series:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return pd.Series([problem(*pair) for pair in zip(paths, sources)], dtype="object")

    return F.pandas_udf(problems, T.StringType())(path, source)


def _source_to_compile() -> Column:
    """The text of a Python file; null, and so never sent to Python, for other files."""
    is_python = X.code_suffix(F.col("rel_path")) == ".py"
    return F.when(is_python, F.coalesce(F.col("content"), F.lit("")))


def check_syntax(code_files: DataFrame) -> DataFrame:
    """One row per checked file with its state: ok, error (with the text) or unchecked.

    Python files are compiled in Arrow batches; the text of other files never leaves the
    JVM. Shell files would need a shell and stay unchecked.
    """
    checked = select_code_files(code_files).select(
        "project_id",
        "entry_file",
        "rel_path",
        _syntax_error(F.col("rel_path"), _source_to_compile()).alias("error"),
    )
    is_python = X.code_suffix(F.col("rel_path")) == ".py"
    return checked.select(
        "project_id",
        "entry_file",
        "rel_path",
        F.when(~is_python, F.lit("unchecked"))
        .when(F.col("error").isNull(), F.lit("ok"))
        .otherwise(F.lit("error"))
        .alias("state"),
        "error",
    )


# Files that start a project, best first.
_ENTRIES = {"run.py": "python", "main.py": "python", "run.sh": "bash"}


# What a project's rows are grouped by; all its rows name the same entry file, if any.
_PROJECT = ["project_id", "entry_file"]


def _entries() -> list[Column]:
    """Aggregates of what decides a project's start command."""
    return [F.max(F.col("rel_path") == name).alias(name) for name in _ENTRIES]


def _command(run_root: str) -> Column:
    command: Column | None = None
    for name, program in _ENTRIES.items():
        start = F.lit(f"{program} {run_root}/{name}")
        found = F.col(f"`{name}`")
        command = F.when(found, start) if command is None else command.when(found, start)
    single = F.col("entry_file")
    return F.when(single.isNotNull(), X.command_for_file(single, run_root)).otherwise(command)


def _command_error() -> Column:
    single = F.col("entry_file")
    return F.when(F.col("command").isNull() & single.isNotNull(), F.lit(C.NO_COMMAND_FOR_FILE)).when(
        F.col("command").isNull(), F.lit(C.NO_COMMAND_FOR_DIR)
    )


def infer_command(code_files: DataFrame, run_root: str = C.RUN_ROOT) -> DataFrame:
    """Start command of every project, or the reason why it has none."""
    projects = code_files.groupBy(*_PROJECT).agg(*_entries())
    return projects.withColumn("command", _command(run_root)).select(
        "project_id", "command", _command_error().alias("reject_reason")
    )


def verify_projects(code_files: DataFrame, run_root: str = C.RUN_ROOT) -> DataFrame:
    """Per project: files checked and their paths, files in error, the first error and the start command.

    ``ok`` is the verdict for a run that brings no command of its own. The errors stay one
    row per file in ``check_syntax``; only the first, in path order, is carried here. Files
    are read once and grouped once for both questions.
    """
    files = code_files.select(
        "project_id",
        "entry_file",
        "rel_path",
        F.coalesce(_is_checked(), F.lit(False)).alias("checked"),
        "content",
    )
    judged = files.select(
        "project_id",
        "entry_file",
        "rel_path",
        "checked",
        _syntax_error(F.col("rel_path"), F.when(F.col("checked"), _source_to_compile())).alias("error"),
    )
    parts = F.split("rel_path", "/").alias("parts")
    by_path = F.struct(parts, F.col("error").alias("error"))
    projects = judged.groupBy(*_PROJECT).agg(
        *_entries(),
        F.count_if("checked").alias("checked_files"),
        F.sort_array(F.collect_list(F.when(F.col("checked"), F.struct(parts, "rel_path")))).alias("paths"),
        F.count("error").alias("error_files"),
        F.min(F.when(F.col("error").isNotNull(), by_path)).alias("first"),
    )
    return projects.withColumn("command", _command(run_root)).select(
        "project_id",
        "checked_files",
        F.col("paths.rel_path").alias("checked_paths"),
        "error_files",
        F.col("first.error").alias("first_error"),
        F.col("command").alias("default_command"),
        _command_error().alias("command_error"),
        (F.col("command").isNotNull() & (F.col("error_files") == 0)).alias("ok"),
    )

"""Tenant scope: the only way to tenant rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Scope:
    """Whose rows are seen: nobody's, everybody's, or a workspace's."""

    system: bool = False
    workspace: object = None

    def __post_init__(self):
        if self.system and self.workspace is not None:
            raise ValueError("a scope is of the system or of a workspace, not both")

    def sees(self, workspace: Column, shared_null: bool = False) -> Column:
        """Whether a row of ``workspace`` is seen; ``shared_null`` shows rows without one to every workspace."""
        if self.system:
            return F.lit(True)
        if self.workspace is None:
            return F.lit(False)
        mine = F.coalesce(workspace == F.lit(self.workspace), F.lit(False))
        return mine | workspace.isNull() if shared_null else mine


NONE, SYSTEM = Scope(), Scope(system=True)


def scoped(df: DataFrame, scope: Scope, workspace: str = "workspace_id", shared_null: bool = False) -> DataFrame:
    """Rows that ``scope`` sees; without a scope, none."""
    return df.where(scope.sees(F.col(workspace), shared_null))


def system_only(df: DataFrame, scope: Scope) -> DataFrame:
    return df.where(F.lit(scope.system))


def members_only(users: DataFrame, memberships: DataFrame, scope: Scope, user: str = "user_id", workspace: str = "workspace_id") -> DataFrame:
    """Users who share the scope's workspace."""
    return users.join(scoped(memberships, scope, workspace).select(user), user, "left_semi")


def checked_write(rows: DataFrame, scope: Scope, workspace: str = "workspace_id") -> DataFrame:
    """``rows``, with an error in place of any row that ``scope`` mustn't write."""
    allowed = F.coalesce(scope.sees(F.col(workspace)), F.lit(False))
    return rows.withColumn(workspace, F.when(allowed, F.col(workspace)).otherwise(F.raise_error(F.lit("row outside the scope")).cast(rows.schema[workspace].dataType)))

"""Names of the key columns that every table of the library carries."""

TENANT = ["tenant_id"]
PROJECT = ["tenant_id", "project_id"]
VERSION = ["tenant_id", "project_id", "dataset_version_id"]
COLUMN = VERSION + ["col_idx"]


def for_tenant(df, tenant_id: str, project_id: str | None = None):
    """Limit a table to one tenant (and project); prunes partitions on tables laid out by tenant."""
    out = df.where(df["tenant_id"] == tenant_id)
    return out if project_id is None else out.where(out["project_id"] == project_id)

"""Row filters: metadata, typed retrieval filter, access control. All are column predicates, so they reach the scan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Caller:
    tenant: str | None
    user: str | None = None
    roles: tuple[str, ...] = ()
    department: str | None = None
    local: bool = False


#: The fields of a retrieval filter.
FIELDS = ("tenant", "document_ids", "source_types", "version", "department", "tags", "since", "until")
COLUMNS = {"tenant": "tenant_id", "id": "doc_id", "type": "source_type", "version": "version_id", "department": "acl_department", "tags": "tags", "at": "created_at"}


@dataclass(frozen=True)
class RetrievalFilter:
    """Optional predicates; since and until are ISO times, compared with a timestamp column as times, else as text."""

    tenant: str | None = None
    document_ids: tuple = ()
    source_types: tuple[str, ...] = ()
    version: str | None = None
    department: str | None = None
    tags: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None
    columns: dict = field(default_factory=lambda: dict(COLUMNS))

    @classmethod
    def of(cls, values: dict, **options) -> RetrievalFilter:
        """From a mapping; unknown fields, lists of other than strings and times that are none are errors."""
        unknown = sorted(set(values) - set(FIELDS))
        if unknown:
            raise ValueError(f"unknown filter fields: {unknown}")
        for k in ("document_ids", "source_types", "tags"):
            if values.get(k) is not None and not (isinstance(values[k], (list, tuple)) and all(isinstance(x, str) for x in values[k])):
                raise ValueError(f"{k} must be a list of strings")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if v is not None}, **options).checked()

    def checked(self) -> RetrievalFilter:
        since, until = (datetime.fromisoformat(x) if x else None for x in (self.since, self.until))
        if since and until and (since.tzinfo is None) == (until.tzinfo is None) and since > until:
            raise ValueError("inverted range")
        return self

    def for_caller(self, caller: Caller) -> RetrievalFilter:
        """The caller's tenant and department over the filter's."""
        return replace(self, tenant=caller.tenant or self.tenant, department=caller.department or self.department)

    def pushed(self) -> dict[str, object]:
        """What a store that knows equality and membership alone can decide: all but tags, times and several types."""
        c, out = self.columns, {}
        for name, value in (("tenant", self.tenant), ("version", self.version), ("department", self.department)):
            if value:
                out[c[name]] = value
        if self.document_ids:
            out[c["id"]] = list(self.document_ids)
        if len(self.source_types) == 1:
            out[c["type"]] = self.source_types[0]
        return out

    def matches(self) -> Column:
        self.checked()
        c, out = self.columns, F.lit(True)
        for name, value in (("tenant", self.tenant), ("version", self.version), ("department", self.department)):
            if value:
                out &= F.col(c[name]) == value
        if self.document_ids:
            out &= F.col(c["id"]).isin(*self.document_ids)
        if self.source_types:
            out &= F.col(c["type"]).isin(*self.source_types)
        if self.tags:
            out &= F.size(F.array_except(F.array(*map(F.lit, self.tags)), c["tags"])) == 0
        if self.since:
            out &= F.col(c["at"]) >= self.since
        if self.until:
            out &= F.col(c["at"]) <= self.until
        return out


def where(conditions: dict[str, object]) -> Column:
    """A store's where clause: values are equal, lists hold, and operator maps ($eq, $ne, $gt, $gte, $lt, $lte, $in, $nin)
    are applied."""
    ops = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v)}
    out = F.lit(True)
    for name, value in conditions.items():
        tests = value if isinstance(value, dict) else {"$in": value} if isinstance(value, (list, tuple)) else {"$eq": value}
        for op, v in tests.items():
            out &= ops[op](F.col(name), v)
    return out


#: Whom a document can be visible to.
VISIBILITIES = ("public", "tenant", "private", "users", "roles", "department")


def acl_list(value: Column) -> Column:
    """array<string> of a JSON array or a comma-separated text, blanks dropped."""
    parsed = F.from_json(value, "array<string>")
    listed = F.when(F.trim(value).startswith("["), parsed)
    return F.filter(F.transform(F.coalesce(listed, F.split(F.coalesce(value, F.lit("")), ",")), lambda x: F.trim(x)), lambda x: x != "")


def stamped(docs: DataFrame, caller: Caller) -> DataFrame:
    """docs with their access columns, what is missing taken from the caller: visible to the tenant, owned by the user. An
    unknown visibility is an error."""
    names = set(docs.columns)
    own = lambda c, kind="string": F.col(c).cast(kind) if c in names else F.lit(None).cast(kind)
    vis = F.lower(F.coalesce(own("acl_visibility"), F.lit("tenant")))
    checked = F.when(vis.isin(*VISIBILITIES), vis).otherwise(F.raise_error(F.concat(F.lit("unknown visibility "), vis)).cast("string"))
    return docs.withColumns({"tenant_id": F.coalesce(own("tenant_id"), F.lit(caller.tenant)), "owner_id": F.coalesce(own("owner_id"), F.lit(caller.user)), "acl_visibility": checked, "acl_users": acl_list(own("acl_users")), "acl_roles": acl_list(own("acl_roles")), "acl_department": F.coalesce(own("acl_department"), F.lit(caller.department), F.lit(""))})


def recall_loss(hits: DataFrame, allowed: Column, overfetch: int) -> DataFrame:
    """query_id, n_in, n_out and whether hits may be lost: as many came as were fetched and some went."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n_in"), F.count_if(F.coalesce(allowed, F.lit(False))).alias("n_out"))
    return n.withColumn("potential_recall_loss", (F.col("n_in") >= overfetch) & (F.col("n_out") < F.col("n_in")))


def can_access(caller: Caller, enabled: bool = True) -> Column:
    """Over tenant_id, owner_id, acl_visibility, acl_users, acl_roles, acl_department; the first rule that applies."""
    if not enabled:
        return F.lit(True)
    tenant, vis = F.col("tenant_id"), F.lower(F.coalesce(F.col("acl_visibility"), F.lit("tenant")))
    roles = F.array(*[F.lit(r.lower()) for r in caller.roles]).cast("array<string>")
    owner = F.coalesce(F.col("owner_id") == F.lit(caller.user), F.lit(False))
    return (
        F.when(tenant.isNotNull() & (tenant != F.lit(caller.tenant)), F.lit(False))
        .when(tenant.isNull(), F.lit(caller.local))
        .when(F.array_contains(roles, "admin"), F.lit(True))
        .when(vis.isin("public", "tenant"), F.lit(True))
        .when(vis == "private", owner)
        .when(vis == "users", owner | F.coalesce(F.array_contains(F.col("acl_users"), F.lit(caller.user)), F.lit(False)))
        .when(vis == "roles", F.arrays_overlap(F.transform("acl_roles", lambda r: F.lower(r)), roles))
        .when(vis == "department", F.coalesce((F.col("acl_department") == F.lit(caller.department)) & (F.col("acl_department") != ""), F.lit(False)))
        .otherwise(F.lit(False))
    )

"""What a running service does with the settings: the active index, limits, caches, and who sees what."""

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import limits, sessions
from quarry.plans import ingest
from quarry.plans.retrieve import Index
from quarry.settings import Settings


class IndexStore:
    """The index that answers, and those of the projects seen before.

    A project without an index leaves the active one as it is. Loading reads nothing yet: an index is
    a set of lazy tables, so keeping those of many projects costs no memory.
    """

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings
        self.index: Index | None = None
        self.project_id: str | None = None
        self.known: dict[str, Index] = {}

    def switch(self, project_id: str) -> bool:
        """Make a project's index the active one; False where it has none."""
        found = self.known.get(project_id) or ingest.load(self.spark, project_id, self.settings)
        if found is None:
            return False
        self.known[project_id] = found
        self.index, self.project_id = found, project_id
        return True

    def ingest(self, source: str | DataFrame, project_id: str, job_id: str | None = None) -> str:
        """Index a source, then answer from it; after an error the active index stays."""
        job = ingest.ingest(self.spark, source, project_id, self.settings, job_id)
        self.known.pop(project_id, None)
        self.switch(project_id)
        return job

    def ready(self) -> bool:
        return self.index is not None


def admitted(requests: DataFrame, settings: Settings, client: str = "client", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Requests with `allowed`. Only a public service limits its clients; requests without a client or a time are refused there."""
    if not settings.public:
        return requests.selectExpr("*", "true as allowed")
    judged = limits.rate_limited(requests, client, time, tie, settings.rate_limit, settings.rate_window)
    return requests.join(judged.select(tie, "allowed"), tie, "left").na.fill(False, ["allowed"])


def embedding_hits(log: DataFrame, settings: Settings, scope: str, key: str) -> DataFrame:
    """Accesses to the embedding cache with `hit`."""
    return limits.lru_hits(log, scope, key, size=settings.embedding_cache)


def query_hits(log: DataFrame, settings: Settings, scope: str, key: str) -> DataFrame:
    """Accesses to the query cache with `hit`."""
    return limits.ttl_hits(log, scope, key, size=settings.query_cache, ttl=settings.query_ttl)


def visible(rows: DataFrame, owner: str | None, settings: Settings) -> DataFrame:
    """The sessions a client may see."""
    return rows.where(sessions.owned(owner, settings.public))


def history(messages: DataFrame, settings: Settings) -> DataFrame:
    """Each session's turns that a question is read with."""
    return sessions.last_turns(messages, settings.history_turns)

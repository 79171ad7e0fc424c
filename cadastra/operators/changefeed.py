"""Applying a stream of inserts, updates and deletes (problem 5)."""

from pyspark.sql import DataFrame

from cadastra.session import salts

#: Every change makes, removes, or does both. Making comes after the removal of the same seq.
_EVENTS = """
SELECT {scope}, entity_type, entity_id, seq, {fields}, true AS __made, operation IN ({replacing}) AS __replaced
FROM {{changes}} WHERE operation IN ('upsert', 'rekey')
UNION ALL
SELECT {scope}, entity_type, CASE WHEN operation = 'rekey' THEN old_entity_id ELSE entity_id END, seq, {nulls}, false, false
FROM {{changes}} WHERE operation IN ('delete', 'rekey')
"""
#: __gone and __base are the barriers: the latest delete, the latest replacement.
_COLUMNS = """
SELECT {scope}, entity_type, entity_id, max(seq) FILTER (WHERE NOT __made) AS __gone, max(seq) FILTER (WHERE __replaced) AS __base,
  max(seq) FILTER (WHERE __made) AS __seq_at, max_by(seq, seq) FILTER (WHERE __made) AS __seq, {last}
FROM ({events}) AS events
WHERE entity_type IS NOT NULL AND entity_id IS NOT NULL AND seq IS NOT NULL
GROUP BY {scope}, entity_type, entity_id
"""
_STATE = """
SELECT {scope}, entity_type, entity_id, seq, {values} FROM (
  SELECT *, CASE WHEN __gone IS NULL OR __seq_at >= __gone THEN __seq END AS seq FROM ({columns}) AS columns
) AS living WHERE seq IS NOT NULL
"""
_CURRENT = """
WITH epochs AS (
  SELECT catalog_instance_id, max(struct(generation, epoch)).epoch AS epoch
  FROM {changes} WHERE catalog_instance_id IS NOT NULL AND epoch IS NOT NULL GROUP BY catalog_instance_id
)
SELECT c.* FROM
  (SELECT *, pmod(xxhash64(entity_id), {salts}) AS __salt FROM {changes}) AS c
  JOIN (SELECT *, explode(sequence(0, {salts} - 1)) AS __salt FROM epochs) AS e
  ON c.catalog_instance_id = e.catalog_instance_id AND c.epoch = e.epoch AND c.__salt = e.__salt
"""


def apply_changes(changes: DataFrame, fields: list[str], scope: list[str] = ("catalog_instance_id",), merge: bool = False) -> DataFrame:
    """The entities that exist after the last change: `scope`, entity_type, entity_id, seq, `fields`.

    changes: `scope`, entity_type, entity_id, old_entity_id, operation (upsert, delete, rekey), seq, `fields`; rows may
    come in any order and repeatedly (same seq and content). upsert makes or replaces; delete removes; rekey removes
    old_entity_id and makes entity_id. seq is the last change that made or replaced the entity.

    The last writer wins column by column, seq included: max_by over the changes that set a column, of which only those
    count that do not come before the latest delete or replacement. An entity without a seq after its latest delete
    does not exist. With merge=False every upsert and rekey is a replacement, so a field it leaves NULL is NULL; with merge=True
    only a rekey is, and an upsert sets its non-NULL fields and leaves the others.

    SQL only, one aggregation, combined before the shuffle: the last setter of a column after the barrier is its last
    setter if that is not before the barrier, so the barrier needs no pass of its own, and an entity with a third of all
    changes is one row per map task. Changes without type, id or seq, and unknown operations, are left out. Two different
    changes with one seq: a removal comes before a making, then the larger field values count.
    """
    setter = "max(seq) FILTER (WHERE __made AND {f} IS NOT NULL) AS `__{f}_at`, max_by({f}, struct(seq, {f})) FILTER (WHERE __made AND {f} IS NOT NULL) AS `__{f}`"
    value = "CASE WHEN `__{f}_at` >= greatest(coalesce(__gone, `__{f}_at`), coalesce(__base, `__{f}_at`)) THEN `__{f}` END AS {f}"
    each = lambda form: ", ".join(form.format(f=f) for f in fields) or "0 AS __none"
    names = ", ".join(scope)
    events = _EVENTS.format(scope=names, fields=each("{f}"), nulls=each("NULL AS {f}"), replacing="'rekey'" if merge else "'upsert', 'rekey'")
    columns = _COLUMNS.format(scope=names, events=events, last=each(setter))
    needed = dict.fromkeys([*scope, "entity_type", "entity_id", "old_entity_id", "operation", "seq", *fields])
    out = changes.sparkSession.sql(_STATE.format(scope=names, columns=columns, values=each(value)), changes=changes.select(*needed))
    return out.select(*scope, "entity_type", "entity_id", "seq", *fields)


def current_epoch(changes: DataFrame) -> DataFrame:
    """The changes of each instance's current epoch: the one with its largest generation (on a tie the larger epoch).

    The epochs' rows are copied to every salt, so an instance with a third of all changes is spread.
    """
    return changes.sparkSession.sql(_CURRENT.replace("{salts}", str(salts(changes.sparkSession))), changes=changes).select(*changes.columns)


def current_entities(changes: DataFrame, fields: list[str] = ()) -> DataFrame:
    """State of every instance after its current epoch."""
    needed = dict.fromkeys(["catalog_instance_id", "epoch", "generation", "entity_type", "entity_id", "old_entity_id", "operation", "seq", *fields])
    return apply_changes(current_epoch(changes.select(*needed)), list(fields))

"""The registered queries as SQL text for a second engine, to compare results."""

from __future__ import annotations

_CASES = """
    cases AS (
        SELECT doc_id AS InventoryId, md5(text) AS Barcode, source AS WarehouseLocationId, lang AS PlantCode,
               n_chars AS ProductId, lang AS PalletNumber, CAST(n_chars AS DOUBLE) AS Weight,
               DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS ProductionDate,
               DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS CreatedDate, lang AS CreatedBy,
               DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) + 1 AS ModifiedDate, source AS ModifiedBy,
               CAST(substr(source, 4) AS INTEGER) % 3 <> 0 AS live
        FROM documents),
    grouped AS (
        SELECT Barcode, count(*) AS cnt, max(InventoryId) AS maxinvid, max(WarehouseLocationId) AS toploc,
               min(WarehouseLocationId) AS botloc
        FROM cases GROUP BY Barcode HAVING count(*) > 1),
    groups AS (
        SELECT c.*, g.cnt, g.maxinvid, CASE WHEN k.live THEN k.WarehouseLocationId END AS maxloc, g.toploc, g.botloc
        FROM cases c
        JOIN grouped g ON g.Barcode IS NOT DISTINCT FROM c.Barcode
        JOIN cases k ON k.InventoryId = g.maxinvid
        WHERE c.WarehouseLocationId NOT IN ('src0', 'src1', 'src2', 'src3')),
    stale AS (SELECT * FROM groups WHERE InventoryId <> maxinvid AND live),
    plan AS (
        SELECT 1 AS step, 'DELETE' AS action, 'DeliveryAllocations' AS target_table, l.doc_id AS InventoryId,
               count(*) AS n_rows
        FROM labels l WHERE l.doc_id IN (SELECT InventoryId FROM stale) GROUP BY l.doc_id
        UNION ALL
        SELECT 2, 'DELETE', 'InventoryCasesQAStatuses', l.doc_id, count(*)
        FROM labels l WHERE l.doc_id IN (SELECT InventoryId FROM stale) GROUP BY l.doc_id
        UNION ALL
        SELECT 3, 'UPDATE', 'InventoryCases', InventoryId, count(*) FROM stale GROUP BY InventoryId)
"""

_REPLENISHMENT = """
    stock AS (
        SELECT l_orderkey AS PalletNumber, l_partkey AS ProductId, l_suppkey AS LocationId,
               CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN l_orderkey END AS DeliveryNumber
        FROM lineitem),
    tasks AS (
        SELECT l_orderkey AS PalletNumber, CASE WHEN l_returnflag = 'R' THEN 7 ELSE 1 END AS StatusId,
               rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC) AS r
        FROM lineitem WHERE l_shipdate IS NOT NULL),
    latest AS (SELECT * FROM tasks WHERE r = 1),
    committed AS (SELECT DISTINCT PalletNumber FROM stock WHERE DeliveryNumber IS NOT NULL),
    blocked AS (
        SELECT p.p_partkey AS LocationId, s.PalletNumber,
               CASE WHEN c.PalletNumber IS NOT NULL THEN 'Pallet is committed to a delivery'
                    ELSE 'Active directed task already exists for pallet' END AS Reason
        FROM stock s
        JOIN part p ON p.p_partkey = s.ProductId
        LEFT JOIN committed c ON c.PalletNumber = s.PalletNumber
        LEFT JOIN latest t ON t.PalletNumber = s.PalletNumber
        WHERE s.LocationId IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 3, 5, 7))
          AND (c.PalletNumber IS NOT NULL OR t.StatusId <> 7))
"""

_SHARED_FACES = _REPLENISHMENT.replace("JOIN part p ON p.p_partkey = s.ProductId", """JOIN (
            SELECT p_partkey, p_partkey - p_partkey % 4 AS product FROM part) p ON p.product = s.ProductId""")

_CARCASS = """
    backtag AS (
        SELECT * FROM (
            SELECT CAST(o_custkey AS VARCHAR) AS CarcassId, o_orderdate AS bt_KillDate,
                   nullif(CAST(o_orderkey % 27 AS INTEGER), 26) AS KillGroupId, o_orderpriority AS bt_PurchaseGroup,
                   o_orderstatus AS bt_CpsTransferStatus, o_orderkey AS bt_Eid,
                   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST,
                       nullif(o_orderkey % 27, 26) NULLS FIRST, o_orderpriority, o_orderstatus, o_orderkey) AS rn
            FROM orders) WHERE rn = 1),
    hot AS (
        SELECT * FROM (
            SELECT CAST(l_orderkey AS VARCHAR) AS CarcassId, l_returnflag AS hot_Side, l_shipdate AS hot_KillDate,
                   l_linenumber AS hot_BackTagKillDate, l_linestatus AS hot_ApprovedBy, l_partkey AS hot_ApprovedDate,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC NULLS LAST,
                       l_returnflag, l_linenumber, l_linestatus, l_partkey) AS rn
            FROM lineitem) WHERE rn = 1),
    epv AS (
        SELECT * FROM (
            SELECT CAST(doc_id AS VARCHAR) AS CarcassId, quality AS epv_Grade, toxic AS epv_QualityProgram,
                   quality AS epv_ApprovedBy, toxic AS epv_ApprovedDate, quality AS epv_CpsTransfer,
                   row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) AS rn
            FROM labels) WHERE rn = 1),
    kg AS (
        SELECT n_nationkey AS KillGroupId, CAST(nullif(n_regionkey, 4) AS VARCHAR) AS ScheduleGroup,
               n_name AS kg_PurchaseGroup, n_nationkey AS kg_HeadCount FROM nation),
    lots AS (
        SELECT nullif(CAST(r_regionkey AS VARCHAR), '3') AS ScheduleGroup, r_regionkey AS lot_ScheduledHeadCount,
               CAST(length(r_name) AS INTEGER) AS lot_ReceivedHeadCount FROM region)
"""

_RECORD = _CARCASS + """,
    record AS (
        SELECT s.CarcassId, kg.ScheduleGroup, b.KillGroupId, b.bt_KillDate, b.bt_PurchaseGroup,
               b.bt_CpsTransferStatus, b.bt_Eid, b.CarcassId IS NOT NULL AS bt_found, kg.kg_PurchaseGroup,
               kg.kg_HeadCount, kg.KillGroupId IS NOT NULL AS kg_found, lots.lot_ScheduledHeadCount,
               lots.lot_ReceivedHeadCount, lots.ScheduleGroup IS NOT NULL AS lot_found, h.hot_Side, h.hot_KillDate,
               h.hot_BackTagKillDate, h.hot_ApprovedBy, h.hot_ApprovedDate, h.CarcassId IS NOT NULL AS hot_found,
               e.epv_Grade, e.epv_QualityProgram, e.epv_ApprovedBy, e.epv_ApprovedDate, e.epv_CpsTransfer,
               e.CarcassId IS NOT NULL AS epv_found,
               (SELECT count(*) FROM events WHERE event_type = 'error' AND contains(props, s.CarcassId)) AS n_messages
        FROM (SELECT CAST(c_custkey AS VARCHAR) AS CarcassId FROM customer) s
        LEFT JOIN backtag b ON b.CarcassId = s.CarcassId
        LEFT JOIN kg ON kg.KillGroupId = b.KillGroupId
        LEFT JOIN lots ON lots.ScheduleGroup = kg.ScheduleGroup
        LEFT JOIN hot h ON h.CarcassId = s.CarcassId
        LEFT JOIN epv e ON e.CarcassId = s.CarcassId),
    statuses AS (
        SELECT CarcassId AS subject, 'latest_backtag' AS "check", CASE WHEN bt_found THEN 'ok' ELSE 'error' END AS status,
               CAST(bt_found AS BIGINT) AS n_findings FROM record
        UNION ALL
        SELECT CarcassId, 'kill_group', CASE WHEN NOT bt_found THEN 'skipped' WHEN kg_found THEN 'ok'
               ELSE 'issues_found' END, CAST(kg_found AS BIGINT) FROM record
        UNION ALL
        SELECT CarcassId, 'lot_details', CASE WHEN NOT bt_found OR NOT kg_found OR ScheduleGroup IS NULL THEN 'skipped'
               WHEN lot_found THEN 'ok' ELSE 'issues_found' END, CAST(lot_found AS BIGINT) FROM record
        UNION ALL
        SELECT CarcassId, 'hot_record', CASE WHEN hot_found THEN 'ok' ELSE 'issues_found' END,
               CAST(hot_found AS BIGINT) FROM record
        UNION ALL
        SELECT CarcassId, 'epv_record', CASE WHEN epv_found THEN 'ok' ELSE 'issues_found' END,
               CAST(epv_found AS BIGINT) FROM record
        UNION ALL
        SELECT CarcassId, 'raw_messages', CASE WHEN n_messages > 0 THEN 'ok' ELSE 'issues_found' END,
               n_messages FROM record)
"""

_ORDERS = """
    headers AS (
        SELECT CAST(o_orderkey AS VARCHAR) AS OrderNumber,
               CASE WHEN o_orderkey % 11 = 0 THEN ' SO' ELSE 'SO' END || o_orderkey AS FileName,
               CAST(o_custkey % 120 AS VARCHAR) AS ThirdPartyId,
               nullif(CAST(o_custkey AS VARCHAR), '7') AS ReferenceOrder, o_orderstatus AS OrderType,
               CASE WHEN o_orderkey % 13 = 0 THEN 'ring|twice' ELSE o_orderpriority END AS Instructions,
               strftime(o_orderdate, '%d/%m/%y') AS DeliveryDate, 'W' || (o_custkey % 30) AS WarehouseCode,
               CAST(o_custkey AS VARCHAR) AS ShipTo, o_orderstatus AS PlantCode
        FROM orders),
    numbered AS (
        SELECT CAST(l_orderkey AS VARCHAR) AS OrderNumber, CAST(l_partkey AS VARCHAR) AS ProductCode,
               CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS BaseQty, coalesce(nullif(l_returnflag, 'N'), '') AS Instructions,
               strftime(l_shipdate, '%d/%m/%y') AS MinSellBy,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR),
                   CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), nullif(l_returnflag, 'N') NULLS FIRST,
                   strftime(l_shipdate, '%d/%m/%y')) AS LineNo
        FROM lineitem),
    details AS (
        SELECT OrderNumber, LineNo, 'D|' || OrderNumber || '|' || lpad(CAST(LineNo AS VARCHAR), 3, '0') || '.00|'
               || ProductCode || '|' || BaseQty || '|' || Instructions || '|' || MinSellBy || '|' AS line
        FROM numbered),
    counts AS (SELECT OrderNumber, count(*) AS n_lines FROM details GROUP BY OrderNumber),
    vendors AS (
        SELECT CAST(s_suppkey AS VARCHAR) AS ThirdPartyId, s_name AS VendorName,
               coalesce(nullif(CAST(s_nationkey AS VARCHAR), '3'), '') AS Street1, '' AS Street2,
               CAST(s_nationkey AS VARCHAR) AS City, CAST(s_suppkey AS VARCHAR) AS ZipCode, '' AS StateProvince
        FROM supplier),
    header_lines AS (
        SELECT h.OrderNumber, h.FileName, coalesce(c.n_lines, 0) AS n_lines,
               'H|' || h.OrderNumber || '|' || coalesce(c.n_lines, 0) || '|' || h.ThirdPartyId || '|'
               || coalesce(v.VendorName, '') || '|' || coalesce(v.Street1, '') || '|' || coalesce(v.Street2, '') || '|'
               || coalesce(v.City, '') || '|' || coalesce(v.ZipCode, '') || '|' || coalesce(v.StateProvince, '') || '|'
               || coalesce(h.ReferenceOrder, '') || '|50|' || h.OrderType || '|' || h.Instructions || '|'
               || h.DeliveryDate || '||00:00|000|' || h.OrderNumber || '|' || h.WarehouseCode || '|' || h.ShipTo || '|'
               || h.PlantCode || '|A|B|' AS line
        FROM headers h
        LEFT JOIN counts c ON c.OrderNumber = h.OrderNumber
        LEFT JOIN vendors v ON v.ThirdPartyId = h.ThirdPartyId),
    validated AS (
        SELECT h.OrderNumber, h.FileName, h.WarehouseCode,
               CASE WHEN h.FileName NOT LIKE 'SO%' THEN 'file name must begin with SO'
                    WHEN c.n_lines IS NULL THEN 'at least one line is required'
                    WHEN contains(h.Instructions, '|') THEN 'field contains delimiter' END AS reject_reason
        FROM headers h LEFT JOIN counts c ON c.OrderNumber = h.OrderNumber),
    codes AS (
        SELECT s_name AS site_code,
               CASE s_suppkey % 10 WHEN 1 THEN 'issues_found' WHEN 2 THEN 'error' WHEN 4 THEN 'error' ELSE 'ok' END AS status,
               CASE WHEN s_suppkey % 10 NOT IN (1, 2, 3, 4) THEN 'W' || s_nationkey END AS WarehouseCode,
               CASE WHEN s_suppkey % 10 NOT IN (1, 2, 3, 4) THEN 'P' || s_suppkey END AS ShippingPoint
        FROM supplier, range(2) copies(i)
        WHERE i = 0 OR s_suppkey % 10 NOT IN (1, 2, 3, 4))
"""

_LOAD = """
    trailer_rows AS (
        SELECT o_custkey AS DeliveryNumber, o_orderkey AS ShipmentNumber, nullif(o_custkey % 120, 0) AS TrailerId
        FROM orders),
    found AS (
        SELECT 'missing_shipment' AS "check", CAST(o_custkey AS VARCHAR) AS subject,
               CAST(o_orderkey AS VARCHAR) AS finding_key,
               json_object('DeliveryNumber', o_custkey, 'ShipmentNumber', o_orderkey)::VARCHAR AS detail, 1 AS n_rows
        FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
        UNION ALL
        SELECT 'missing_trailer', CAST(DeliveryNumber AS VARCHAR), CAST(ShipmentNumber AS VARCHAR),
               json_object('DeliveryNumber', DeliveryNumber, 'ShipmentNumber', ShipmentNumber,
                           'TrailerId', TrailerId)::VARCHAR, count(*)
        FROM trailer_rows
        WHERE TrailerId IS NULL AND DeliveryNumber IN (SELECT c_custkey FROM customer)
        GROUP BY DeliveryNumber, ShipmentNumber, TrailerId
        UNION ALL
        SELECT 'missing_trailer_capacity', CAST(t.DeliveryNumber AS VARCHAR), CAST(t.TrailerId AS VARCHAR),
               json_object('DeliveryNumber', t.DeliveryNumber, 'ShipmentNumber', t.ShipmentNumber,
                           'TrailerId', t.TrailerId)::VARCHAR, count(*)
        FROM trailer_rows t LEFT JOIN supplier s ON s.s_suppkey = t.TrailerId
        WHERE (s.s_suppkey IS NULL OR s.s_acctbal <= 0) AND t.DeliveryNumber IN (SELECT c_custkey FROM customer)
        GROUP BY t.DeliveryNumber, t.ShipmentNumber, t.TrailerId
        UNION ALL
        SELECT 'missing_allocations', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR),
               json_object('DeliveryNumber', o_custkey, 'InventoryId', o_orderkey)::VARCHAR, 1
        FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer)
          AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)),
    statuses AS (
        SELECT k."check", CAST(c_custkey AS VARCHAR) AS subject, coalesce(f.n, 0) AS n_findings,
               CASE WHEN k."check" = 'missing_shipment' THEN
                        CASE WHEN f.n > 0 THEN 'ok' ELSE 'issues_found' END
                    WHEN f.n > 0 THEN 'issues_found' ELSE 'ok' END AS status
        FROM customer
        CROSS JOIN (VALUES ('missing_shipment'), ('missing_trailer'), ('missing_trailer_capacity'),
                           ('missing_allocations')) k("check")
        LEFT JOIN (SELECT "check", subject, CAST(sum(n_rows) AS BIGINT) AS n FROM found GROUP BY 1, 2) f
          ON f."check" = k."check" AND f.subject = CAST(c_custkey AS VARCHAR))
"""

_SUITE = """
    wanted AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'),
    unallocated AS (
        SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = w.o_orderkey)),
    siblings AS (SELECT o_orderkey FROM wanted WHERE o_custkey IN (SELECT o_custkey FROM unallocated))
"""


def _summary(scenario: str, statuses: str, environments: str = "PROD,QA", units: str = "Beef/Pork",
             extra: str = "") -> str:
    quoted = scenario.replace("'", "''")
    return f"""
        SELECT '{quoted}' AS scenario, subject,
               count(*) FILTER (status <> 'skipped') AS ran, count(*) FILTER (status = 'ok') AS clean,
               count(*) FILTER (status = 'issues_found') AS issues, count(*) FILTER (status = 'error') AS errors,
               count(*) FILTER (status = 'skipped') AS skipped,
               CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 'error'
                    WHEN count(*) FILTER (status = 'issues_found') > 0 THEN 'issues_found' ELSE 'ok' END AS overall,
               '{environments}' AS environments, '{units}' AS business_units{extra}
        FROM {statuses} GROUP BY subject"""


_FAILED = """
    SELECT event_type AS PosterType, count(event_id) AS FailedCount FROM events
    WHERE value < 5 AND event_type IN ('click', 'error', 'purchase')
      AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50
    GROUP BY event_type
"""
_BACKLOG = """
    SELECT event_type AS MessageName, count(*) AS PendingCount FROM events
    WHERE event_type NOT IN ('purchase', 'error') AND CAST(ts AS DATE) = DATE '2024-01-15'
    GROUP BY event_type
"""
_HOLDS = """
    SELECT o_orderkey AS InventoryId FROM orders
    WHERE o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED'
    UNION
    SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'P' AND (l_returnflag IS NULL OR l_returnflag = 'N')
"""
_UNALLOCATED = """
    SELECT o_custkey AS DeliveryNumber, o_orderkey AS InventoryId FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
"""
_MESSAGES = """
    SELECT CAST(s_suppkey AS VARCHAR) AS CarcassId, event_id AS MessageId, user_id AS StatusId, props AS Data
    FROM supplier JOIN events ON event_type = 'error' AND {match}
"""
_REJECTS = """
    SELECT OrderNumber, reject_reason FROM validated WHERE reject_reason IS NOT NULL
    UNION ALL
    SELECT OrderNumber, 'unknown warehouse code' FROM validated
    WHERE reject_reason IS NULL
      AND WarehouseCode NOT IN (SELECT c.WarehouseCode FROM codes c WHERE c.WarehouseCode IS NOT NULL)
"""
_PAYLOADS = """
    SELECT d.OrderNumber, trim(h.FileName) AS FileName, d.part,
           CAST(ceil(h.n_lines / {size}) AS BIGINT) AS n_parts,
           CASE WHEN d.part = 0 THEN '{{"FileName":"' || trim(h.FileName) || '","FileLines":["' || h.line || '"' ELSE '' END
           || ',' || d.body || CASE WHEN d.part = ceil(h.n_lines / {size}) - 1 THEN '],"ExtraInfo":null}}' ELSE '' END AS payload
    FROM (SELECT OrderNumber, CAST((LineNo - 1) // {size} AS BIGINT) AS part,
                 string_agg('"' || line || '"', ',' ORDER BY LineNo) AS body
          FROM details GROUP BY 1, 2) d
    JOIN header_lines h ON h.OrderNumber = d.OrderNumber
"""
_BUILDER = """
    builder AS (
        SELECT h.OrderNumber AS subject, 'vendor_lookup' AS "check",
               CASE WHEN v.ThirdPartyId IS NULL THEN 'issues_found' ELSE 'ok' END AS status,
               CAST(v.ThirdPartyId IS NOT NULL AS BIGINT) AS n_findings
        FROM headers h LEFT JOIN vendors v ON v.ThirdPartyId = h.ThirdPartyId
        UNION ALL
        SELECT OrderNumber, 'warehouse_code', CASE WHEN known THEN 'ok' ELSE 'issues_found' END, CAST(known AS BIGINT)
        FROM (SELECT OrderNumber, WarehouseCode IN (SELECT c.WarehouseCode FROM codes c WHERE c.WarehouseCode IS NOT NULL) AS known
              FROM headers)
        UNION ALL
        SELECT OrderNumber, 'valid_order', CASE WHEN reject_reason IS NULL THEN 'ok' ELSE 'error' END,
               CAST(reject_reason IS NOT NULL AS BIGINT) FROM validated)
"""
_CHAIN = """
    SELECT CAST(c_custkey AS VARCHAR) AS CarcassId, c_nationkey AS KillGroupId, kg.ScheduleGroup{kg},
           kg.kg_PurchaseGroup, kg.kg_HeadCount, kg.KillGroupId IS NOT NULL AS kg_found{lots}
    FROM customer LEFT JOIN kg ON kg.KillGroupId = c_nationkey
    LEFT JOIN lots ON lots.ScheduleGroup = kg.ScheduleGroup
"""
_BACKTAG_COLUMNS = """s.CarcassId, bt_KillDate, KillGroupId AS bt_KillGroupId, bt_PurchaseGroup,
    bt_CpsTransferStatus, bt_Eid, b.CarcassId IS NOT NULL AS bt_found"""
_CARCASSES = "(SELECT CAST(c_custkey AS VARCHAR) AS CarcassId FROM customer) s LEFT JOIN backtag b ON b.CarcassId = s.CarcassId"

ORACLES: dict[str, str] = {
    "missing_allocations": _UNALLOCATED,
    "missing_allocations_any_case": """
        WITH inventory AS (
            SELECT o_custkey AS DeliveryNumber,
                   CASE WHEN o_orderkey % 3 = 0 THEN 'HOT' ELSE 'LOT É' || o_orderkey END AS InventoryId FROM orders)
        SELECT DeliveryNumber, InventoryId FROM inventory
        WHERE lower(InventoryId) NOT IN (SELECT 'lot é' || l_orderkey FROM lineitem WHERE l_linenumber > 3)""",
    "missing_shipment": "SELECT doc_id AS DeliveryNumber FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "found_shipments": "SELECT o_custkey AS DeliveryNumber, o_orderkey AS ShipmentNumber FROM orders "
                       "WHERE o_custkey IN (SELECT c_custkey FROM customer)",
    "missing_trailer": """
        SELECT p.DeliveryNumber, o_orderkey AS ShipmentNumber, CAST(NULL AS VARCHAR) AS TrailerId, count(*) AS n_rows
        FROM (SELECT DISTINCT l_suppkey AS DeliveryNumber, l_orderkey FROM lineitem) p
        JOIN orders ON o_orderkey = p.l_orderkey AND o_orderpriority = '4-NOT SPECIFIED'
        GROUP BY 1, 2""",
    "missing_trailer_capacity": """
        SELECT d.source AS DeliveryNumber, s.doc_id AS ShipmentNumber, s.doc_id AS TrailerId, count(*) AS n_rows
        FROM documents d JOIN documents s ON s.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = s.doc_id
        WHERE l.quality IS NULL OR l.quality = 0 GROUP BY 1, 2, 3""",
    "missing_hold_reason": _HOLDS,
    "failed_transactions": _FAILED,
    "pending_backlog": _BACKLOG,
    "backlog_status": f"""
        SELECT CAST(coalesce(sum(PendingCount), 0) AS BIGINT) AS total_pending, count(*) AS n_names,
               CASE WHEN coalesce(sum(PendingCount), 0) >= 25 THEN 'issues_found' ELSE 'ok' END AS status
        FROM ({_BACKLOG})""",
    "replenishment_blocked": f"WITH {_REPLENISHMENT} SELECT LocationId, PalletNumber, Reason, count(*) AS n_rows "
                             "FROM blocked GROUP BY 1, 2, 3",
    "replenishment_blocked_rows": f"WITH {_REPLENISHMENT} SELECT LocationId, PalletNumber, Reason FROM blocked",
    "blocked_counts": f"""WITH {_REPLENISHMENT}
        SELECT LocationId, count(DISTINCT PalletNumber) AS n_pallets, count(*) AS n_rows FROM blocked GROUP BY LocationId""",
    "blocked_pairs": f"WITH {_SHARED_FACES} SELECT LocationId, PalletNumber, Reason, count(*) AS n_rows FROM blocked GROUP BY 1, 2, 3",
    "blocked_pallets": f"""WITH {_SHARED_FACES},
        pairs AS (
            SELECT p_partkey - p_partkey % 4 AS ProductId, LocationId, PalletNumber, Reason, count(*) AS n_rows
            FROM blocked JOIN part ON p_partkey = LocationId GROUP BY 1, 2, 3, 4)
        SELECT ProductId, PalletNumber, Reason, n_rows, count(*) AS n_faces FROM pairs GROUP BY 1, 2, 3, 4""",
    "pick_face_products": "SELECT p_partkey AS LocationId, p_partkey - p_partkey % 4 AS ProductId FROM part",
    "listed_allocations": f"""
        SELECT *, row_number() OVER (PARTITION BY DeliveryNumber ORDER BY InventoryId NULLS FIRST) AS position FROM ({_UNALLOCATED})""",
    "listed_backlog": f"""
        SELECT *, row_number() OVER (ORDER BY PendingCount DESC, MessageName) AS position FROM ({_BACKLOG})""",
    "listed_duplicates": f"""WITH {_CASES}
        SELECT ProductionDate, InventoryId AS DuplicateInventoryId, Barcode,
               row_number() OVER (ORDER BY ProductionDate, InventoryId, Barcode) AS position FROM stale""",
    "listed_messages": "SELECT *, row_number() OVER (PARTITION BY CarcassId ORDER BY MessageId, StatusId, Data) AS position FROM ("
                       + _MESSAGES.format(match="contains(props, CAST(s_suppkey AS VARCHAR))") + ")",
    "blocked_pallet_lines": f"""WITH {_REPLENISHMENT}
        SELECT LocationId, rpad(CAST(PalletNumber AS VARCHAR), 20, ' ') || ' ' || Reason AS line
        FROM blocked GROUP BY LocationId, PalletNumber, Reason""",
    "duplicate_groups": f"WITH {_CASES} SELECT * FROM groups",
    "stale_duplicates": f"""WITH {_CASES}
        SELECT ProductionDate, ProductId, PalletNumber, Barcode, Weight, cnt AS DuplicateCount,
               maxloc AS CurrentLocation, maxinvid AS CurrentInventoryId, WarehouseLocationId AS DuplicateLocation,
               InventoryId AS DuplicateInventoryId, CreatedDate, CreatedBy, ModifiedDate, ModifiedBy FROM stale""",
    "stale_lines": f"""WITH {_CASES}
        SELECT InventoryId AS DuplicateInventoryId,
               InventoryId || ' | ' || Barcode || ' | ' || coalesce(maxloc, 'None') AS line FROM stale""",
    "remediation_plan": f"WITH {_CASES} SELECT * FROM plan",
    "remediate_cases": f"""WITH {_CASES}
        SELECT * EXCLUDE (live) REPLACE (
            CASE WHEN InventoryId IN (SELECT InventoryId FROM stale) THEN 'LVADJ' ELSE WarehouseLocationId END AS WarehouseLocationId,
            CASE WHEN InventoryId IN (SELECT InventoryId FROM stale) THEN 'DuplicatedJob' ELSE ModifiedBy END AS ModifiedBy,
            CASE WHEN InventoryId IN (SELECT InventoryId FROM stale) THEN DATE '2024-06-01' ELSE ModifiedDate END AS ModifiedDate)
        FROM cases""",
    "remediate_allocations": f"WITH {_CASES} SELECT doc_id AS InventoryId, quality AS Quality FROM labels "
                             "WHERE doc_id NOT IN (SELECT InventoryId FROM stale)",
    "apply_plan": f"WITH {_CASES} SELECT doc_id AS InventoryId, quality AS Quality FROM labels "
                  "WHERE doc_id NOT IN (SELECT InventoryId FROM stale)",
    "deleted_allocations": f"WITH {_CASES} SELECT doc_id AS InventoryId, quality AS Quality FROM labels "
                           "WHERE doc_id IN (SELECT InventoryId FROM stale)",
    "remediate_hold_statuses": f"WITH {_CASES} SELECT doc_id AS InventoryId, toxic AS QAStatusCode FROM labels "
                               "WHERE doc_id NOT IN (SELECT InventoryId FROM stale)",
    "remediation_scripts": f"""WITH {_CASES},
        ids AS (
            SELECT step, target_table, action, InventoryId,
                   (row_number() OVER (PARTITION BY step ORDER BY InventoryId) - 1) // 10 AS batch FROM plan)
        SELECT step, target_table, batch, count(*) AS n_ids,
               '-- ' || (SELECT upper(min(PlantCode)) FROM cases) || chr(10) || '-- DB01' || chr(10) || chr(10)
               || 'BEGIN TRAN t1' || chr(10) || chr(10)
               || CASE WHEN action = 'UPDATE' THEN 'UPDATE InventoryCases' || chr(10)
                       || '    SET WarehouseLocationId = ''LVADJ'',' || chr(10)
                       || '        ModifiedBy          = ''DuplicatedJob'',' || chr(10)
                       || '        ModifiedDate        = GETDATE()'
                  ELSE 'DELETE FROM ' || target_table END || chr(10)
               || 'WHERE InventoryId IN (' || chr(10) || '    '
               || string_agg('''' || InventoryId || '''', ',' || chr(10) || '    ' ORDER BY InventoryId) || chr(10)
               || ')' || chr(10) || chr(10) || '-- COMMIT TRAN t1' || chr(10) || '-- ROLLBACK TRAN t1' AS script
        FROM ids GROUP BY step, target_table, action, batch""",
    "in_clause": f"""
        WITH ids AS (
            SELECT InventoryId, (row_number() OVER (ORDER BY InventoryId) - 1) // 100 AS batch
            FROM (SELECT DISTINCT InventoryId FROM ({_UNALLOCATED})))
        SELECT batch, count(*) AS n_ids, '(' || string_agg('''' || InventoryId || '''', ', ' ORDER BY InventoryId) || ')' AS clause
        FROM ids GROUP BY batch""",
    "latest_backtag": f"WITH {_CARCASS} SELECT {_BACKTAG_COLUMNS} FROM {_CARCASSES}",
    "backtag_lines": f"""WITH {_CARCASS},
        fields AS (
            SELECT s.CarcassId, f.position, f.field, CASE f.position WHEN 0 THEN CAST(KillGroupId AS VARCHAR)
                   WHEN 1 THEN bt_PurchaseGroup WHEN 2 THEN bt_CpsTransferStatus ELSE CAST(bt_Eid AS VARCHAR) END AS value
            FROM {_CARCASSES}
            CROSS JOIN (VALUES (0, 'bt_KillGroupId'), (1, 'bt_PurchaseGroup'), (2, 'bt_CpsTransferStatus'),
                               (3, 'bt_Eid')) f(position, field))
        SELECT *, field || ': ' || coalesce(value, 'None') AS line FROM fields""",
    "hot_record": f"""WITH {_CARCASS}
        SELECT CAST(o_orderkey AS VARCHAR) AS CarcassId, hot_Side, hot_KillDate, hot_BackTagKillDate, hot_ApprovedBy,
               hot_ApprovedDate, h.CarcassId IS NOT NULL AS hot_found
        FROM orders LEFT JOIN hot h ON h.CarcassId = CAST(o_orderkey AS VARCHAR)""",
    "epv_record": f"""WITH {_CARCASS}
        SELECT CAST(d.doc_id AS VARCHAR) AS CarcassId, epv_Grade, epv_QualityProgram, epv_ApprovedBy, epv_ApprovedDate,
               epv_CpsTransfer, e.CarcassId IS NOT NULL AS epv_found
        FROM documents d LEFT JOIN epv e ON e.CarcassId = CAST(d.doc_id AS VARCHAR)""",
    "kill_group": f"WITH {_CARCASS}" + _CHAIN.format(kg=" AS kg_ScheduleGroup", lots=""),
    "lot_details": f"WITH {_CARCASS}" + _CHAIN.format(
        kg="", lots=", lot_ScheduledHeadCount, lot_ReceivedHeadCount, lots.ScheduleGroup IS NOT NULL AS lot_found"),
    "raw_messages": _MESSAGES.format(match="contains(props, CAST(s_suppkey AS VARCHAR))"),
    "raw_messages_by_token": _MESSAGES.format(
        match="list_contains(regexp_extract_all(props, '[A-Za-z0-9]+'), CAST(s_suppkey AS VARCHAR))"),
    "raw_messages_like": """
        WITH ids AS (
            SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'k%' || s_suppkey WHEN 1 THEN s_suppkey || '_'
                   ELSE CAST(s_suppkey AS VARCHAR) END AS CarcassId FROM supplier)
        SELECT CarcassId, event_id AS MessageId, user_id AS StatusId, props AS Data
        FROM ids JOIN events ON event_type = 'error' AND props LIKE '%' || CarcassId || '%'""",
    "raw_messages_of_one": "SELECT '7' AS CarcassId, event_id AS MessageId, user_id AS StatusId, props AS Data "
                           "FROM events WHERE event_type = 'error' AND contains(props, '7')",
    "carcass_record": f"WITH {_RECORD} SELECT * FROM record",
    "carcass_statuses": f"WITH {_RECORD} SELECT * FROM statuses",
    "carcass_summary": f"WITH {_RECORD}" + _summary(
        "Carcass Lookup", "statuses", extra=", count(*) FILTER (status = 'error') > 0 AS gate_failed"),
    "vendor_lookup": f"""WITH {_ORDERS}
        SELECT h.OrderNumber, h.ThirdPartyId, coalesce(VendorName, '') AS VendorName, coalesce(Street1, '') AS Street1,
               coalesce(Street2, '') AS Street2, coalesce(City, '') AS City, coalesce(ZipCode, '') AS ZipCode,
               coalesce(StateProvince, '') AS StateProvince, v.ThirdPartyId IS NOT NULL AS vendor_found
        FROM headers h LEFT JOIN vendors v ON v.ThirdPartyId = h.ThirdPartyId""",
    "vendor_statuses": f"""WITH {_ORDERS}
        SELECT 'vendor_lookup' AS "check", h.OrderNumber AS subject,
               CASE WHEN v.ThirdPartyId IS NULL THEN 'issues_found' ELSE 'ok' END AS status,
               CASE WHEN v.ThirdPartyId IS NULL THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS n_findings,
               CASE WHEN v.ThirdPartyId IS NULL THEN 'No vendor found (0)' ELSE '1 vendor(s) found' END AS headline
        FROM headers h LEFT JOIN vendors v ON v.ThirdPartyId = h.ThirdPartyId""",
    "warehouse_codes": f"WITH {_ORDERS} SELECT * FROM codes",
    "warehouse_code_statuses": f"""WITH {_ORDERS},
        states AS (
            SELECT site_code AS subject, min(status) AS status, count(WarehouseCode) AS n FROM codes GROUP BY site_code
            UNION ALL SELECT n_name, 'issues_found', 0 FROM nation)
        SELECT 'warehouse_codes' AS "check", subject, status, n AS n_findings, CASE status
               WHEN 'ok' THEN n || ' warehouse code(s) read' WHEN 'error' THEN 'The warehouse code setting is no list of codes (0)'
               ELSE 'No warehouse code setting found (0)' END AS headline FROM states""",
    "order_header_lines": f"WITH {_ORDERS} SELECT * FROM header_lines",
    "order_detail_lines": f"WITH {_ORDERS} SELECT * FROM details",
    "order_payloads": f"WITH {_ORDERS}" + _PAYLOADS.format(size=10000),
    "order_files": f"WITH {_ORDERS} SELECT * FROM (" + _PAYLOADS.format(size=10000) + """) WHERE OrderNumber IN (
        SELECT OrderNumber FROM validated WHERE reject_reason IS NULL
        AND WarehouseCode IN (SELECT c.WarehouseCode FROM codes c WHERE c.WarehouseCode IS NOT NULL))""",
    "order_builder_statuses": f"WITH {_ORDERS}, {_BUILDER} SELECT * FROM builder",
    "order_builder_summary": f"WITH {_ORDERS}, {_BUILDER}" + _summary("Order Builder", "builder"),
    "written_payloads": f"WITH {_ORDERS}" + _PAYLOADS.format(size=10000),
    "order_payload_parts": f"WITH {_ORDERS}" + _PAYLOADS.format(size=3),
    "validate_orders": f"WITH {_ORDERS} SELECT OrderNumber, FileName, reject_reason FROM validated",
    "unknown_warehouse_codes": f"""WITH {_ORDERS} SELECT OrderNumber, WarehouseCode FROM headers
        WHERE WarehouseCode NOT IN (SELECT c.WarehouseCode FROM codes c WHERE c.WarehouseCode IS NOT NULL)""",
    "order_file_rejects": f"WITH {_ORDERS}" + _REJECTS,
    "findings": f"""
        SELECT 'missing_allocations' AS "check", CAST(DeliveryNumber AS VARCHAR) AS subject,
               CAST(InventoryId AS VARCHAR) AS finding_key,
               json_object('DeliveryNumber', DeliveryNumber, 'InventoryId', InventoryId)::VARCHAR AS detail,
               CAST(1 AS BIGINT) AS n_rows FROM ({_UNALLOCATED})""",
    "check_status": f"""
        SELECT 'missing_allocations' AS "check", CAST(c_custkey AS VARCHAR) AS subject,
               CASE WHEN count(InventoryId) > 0 THEN 'issues_found' ELSE 'ok' END AS status,
               count(InventoryId) AS n_findings,
               CASE WHEN count(InventoryId) > 0 THEN count(InventoryId) || ' inventory id(s) without an allocation'
                    ELSE 'All inventory is allocated (0)' END AS headline
        FROM customer LEFT JOIN ({_UNALLOCATED}) ON DeliveryNumber = c_custkey GROUP BY c_custkey""",
    "written_findings": f"WITH {_LOAD} SELECT * FROM found",
    "load_wont_close_findings": f"WITH {_LOAD} SELECT * FROM found",
    "load_wont_close_statuses": f"""WITH {_LOAD}
        SELECT "check", subject, status, n_findings, CASE "check"
            WHEN 'missing_shipment' THEN CASE WHEN n_findings > 0 THEN n_findings || ' shipment(s) found'
                 ELSE 'No shipment found (0)' END
            WHEN 'missing_trailer' THEN CASE WHEN n_findings > 0 THEN n_findings || ' shipment(s) without a trailer'
                 ELSE 'No shipment lacks a trailer (0)' END
            WHEN 'missing_trailer_capacity' THEN CASE WHEN n_findings > 0
                 THEN n_findings || ' trailer(s) without a capacity' ELSE 'No trailer lacks a capacity (0)' END
            ELSE CASE WHEN n_findings > 0 THEN n_findings || ' inventory id(s) without an allocation'
                 ELSE 'All inventory is allocated (0)' END END AS headline
        FROM statuses""",
    "load_wont_close_summary": f"WITH {_LOAD}" + _summary("Load Won't Close", "statuses"),
    "inventory_cant_release": _summary(
        "Inventory Can't Be Released",
        f"(SELECT '*' AS subject, CASE WHEN count(*) > 0 THEN 'issues_found' ELSE 'ok' END AS status FROM ({_HOLDS}))"),
    "message_delay": f"""
        SELECT 'pending_backlog' AS "check", '*' AS subject,
               CASE WHEN n >= 25 THEN 'issues_found' ELSE 'ok' END AS status, n AS n_findings,
               n || CASE WHEN n >= 25 THEN ' pending message(s), a backlog'
                         ELSE ' pending message(s), below the threshold' END AS headline
        FROM (SELECT CAST(coalesce(sum(PendingCount), 0) AS BIGINT) AS n FROM ({_BACKLOG}))""",
    "pallet_wont_replenish": f"WITH {_REPLENISHMENT}" + _summary(
        "Pallet Won't Replenish to Location",
        "(SELECT CAST(p_partkey AS VARCHAR) AS subject, CASE WHEN EXISTS (SELECT 1 FROM blocked b "
        "WHERE b.LocationId = p_partkey) THEN 'issues_found' ELSE 'ok' END AS status FROM part)"),
    "pallet_wont_replenish_asked": f"""WITH {_REPLENISHMENT}
        SELECT 'replenishment_blocked' AS "check", CAST(asked AS VARCHAR) AS subject, n AS n_findings,
               CASE WHEN n > 0 THEN 'issues_found' ELSE 'ok' END AS status,
               CASE WHEN n > 0 THEN n || ' pallet line(s) blocked' ELSE 'No blocked pallets (0)' END AS headline
        FROM (SELECT asked, count(LocationId) AS n FROM (
                  SELECT s_suppkey AS asked FROM supplier UNION SELECT -s_suppkey FROM supplier)
              LEFT JOIN blocked ON LocationId = asked GROUP BY asked)""",
    "duplicate_inventory_findings": f"""WITH {_CASES}
        SELECT 'duplicate_inventory' AS "check", '*' AS subject, CAST(InventoryId AS VARCHAR) AS finding_key,
               1 AS n_rows FROM stale
        UNION ALL
        SELECT CASE step WHEN 1 THEN 'remediate_allocations' WHEN 2 THEN 'remediate_hold_statuses'
               ELSE 'remediate_cases' END, '*', CAST(InventoryId AS VARCHAR), n_rows FROM plan""",
    "duplicate_inventory_summary": f"WITH {_CASES}" + _summary(
        "Duplicate Inventory",
        "(SELECT '*' AS subject, step, CASE WHEN n > 0 THEN 'issues_found' ELSE 'ok' END AS status FROM "
        "(SELECT 0 AS step, count(*) AS n FROM stale UNION ALL SELECT 1, count(*) FROM plan WHERE step = 1 UNION ALL "
        "SELECT 2, count(*) FROM plan WHERE step = 2 UNION ALL SELECT 3, count(*) FROM plan WHERE step = 3))",
        extra=", count(*) FILTER (status = 'issues_found' AND step > 0) AS scripts"),
    "missing_carcasses": _summary(
        "Missing Carcasses",
        f"(SELECT '*' AS subject, CASE WHEN count(*) > 0 THEN 'issues_found' ELSE 'ok' END AS status FROM ({_FAILED}))"),
    "failed_transactions_summary": _summary(
        "Failed Transactions",
        f"(SELECT '*' AS subject, CASE WHEN count(*) > 0 THEN 'issues_found' ELSE 'ok' END AS status FROM ({_FAILED}))"),
    "suite_findings": f"""WITH {_SUITE}
        SELECT 'Open orders' AS suite, 'Orders without lines' AS title, 'unallocated' AS "check",
               CAST(o_orderkey AS VARCHAR) AS finding_key, o_orderkey || ' | ' || o_custkey AS detail FROM unallocated
        UNION ALL
        SELECT 'Open orders', 'Other orders of the same customers', 'siblings', CAST(o_orderkey AS VARCHAR),
               CAST(o_orderkey AS VARCHAR) FROM siblings""",
    "suite_statuses": f"""WITH {_SUITE}
        SELECT 'unallocated' AS "check", CASE WHEN count(*) > 0 THEN 'issues_found' ELSE 'ok' END AS status,
               count(*) AS n_findings FROM unallocated
        UNION ALL
        SELECT 'siblings', CASE WHEN count(*) > 0 THEN 'issues_found' ELSE 'ok' END, count(*) FROM siblings
        UNION ALL SELECT 'broken', 'error', 0 UNION ALL SELECT 'after_broken', 'skipped', 0""",
    "suite_summary": f"WITH {_SUITE}" + _summary(
        "Open orders",
        "(SELECT '*' AS subject, CASE WHEN count(*) > 0 THEN 'issues_found' ELSE 'ok' END AS status FROM unallocated "
        "UNION ALL SELECT '*', CASE WHEN count(*) > 0 THEN 'issues_found' ELSE 'ok' END FROM siblings "
        "UNION ALL SELECT '*', 'error' UNION ALL SELECT '*', 'skipped')", "PROD", "Poultry"),
    "fleet_missing_allocations": f"""
        SELECT DeliveryNumber, InventoryId, site_code FROM ({_UNALLOCATED}) CROSS JOIN (VALUES ('S1'), ('S2')) s(site_code)""",
}

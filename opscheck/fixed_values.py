"""Fixed values.

Every constant here has to equal the value the checked systems use, otherwise
the results differ.  All of them are defaults of operator arguments.
"""

# Locations whose copies are counted as duplicates but never reported as stale.
IGNORED_LOCATIONS = (
    "SHIPPED", "SHIPRTN", "ADJUST", "LVADJ",
    "HAM1", "HAM2", "BELLY", "MHARV",
    "BLEND1", "BLEND2", "BLEND3", "BLEND4", "BLEND5", "BLEND6",
    "TB2",
)

# Where a stale copy is moved to, and the name that signs the change.
ADJUSTMENT_LOCATION = "LVADJ"
REMEDIATION_USER = "DuplicatedJob"

# Tables touched by the remediation, in the order the steps have to run.
ALLOCATIONS_TABLE = "DeliveryAllocations"
QA_STATUSES_TABLE = "InventoryCasesQAStatuses"
CASES_TABLE = "InventoryCases"

# Texts of the remediation scripts
SCRIPT_OPENING = "\nBEGIN TRAN t1\n"
SCRIPT_CLOSING = ")\n\n-- COMMIT TRAN t1\n-- ROLLBACK TRAN t1"
SCRIPT_CHANGES = (
    ("WarehouseLocationId", f"'{ADJUSTMENT_LOCATION}'"),
    ("ModifiedBy", f"'{REMEDIATION_USER}'"),
    ("ModifiedDate", "GETDATE()"),
)

# Holds
HOLD_STATUS = "HLD"

# Failed transactions
FAIL_STATUS = -3
POSTER_TYPES = (
    "InventoryAdjustment",
    "OrderAcknowledgement",
    "InventoryStatus",
    "TrailerStatus",
    "OrderDetailChange",
    "ShipLoad",
    "PorkHotCarcass",
)

# Outbound message backlog
FINAL_MESSAGE_STATUSES = ("COMPLETED", "ERROR")
BACKLOG_THRESHOLD = 25

# Replenishment
CLOSED_TASK_STATUS = 7
REASON_COMMITTED = "Pallet is committed to a delivery"
REASON_ACTIVE_TASK = "Active directed task already exists for pallet"
REASON_UNKNOWN = "Unknown — pallet should be eligible, check sort order"

# Raw interface messages
MESSAGE_SERVICE = "EPVService"

# Settings keys (package, code)
ZONES_SETTING = ("Protein.ShopFloor.Dashboard", "ReplenishmentZones")
WAREHOUSE_CODES_SETTING = (
    "Protein.ShopFloor.InterfaceTasks.ProntoFileInterface",
    "ProntoWhseCodeSFShippingPointMapping",
)
WAREHOUSE_CODE_FIELD = "ProntoWhseCode"
SHIPPING_POINT_FIELD = "SFShippingPoint"

# Order payloads
FILE_NAME_PREFIX = "SO"
FIELD_DELIMITER = "|"
DEFAULT_PRIORITY = "50"
DEFAULT_DELIVERY_TIME = "00:00"
DEFAULT_GEO_CODE = "000"

# Fields of order payloads, in their order
ORDER_LINE_FIELDS = ("ProductCode", "BaseQty", "Instructions", "MinSellBy")
ORDER_HEADER_FIELDS = (
    "ThirdPartyId", "ReferenceOrder", "Priority", "OrderType", "Instructions", "DeliveryDate",
    "LoadDate", "DeliveryTime", "GeoCode", "WarehouseCode", "ShipTo", "PlantCode", "SenderId",
    "ReceiverId",
)

# Site registry defaults
SITE_DEFAULTS = {
    "name": "Unnamed Plant",
    "code": "???",
    "server": "",
    "database": "",
    "environment": "PROD",
    "notes": "",
}

# Where scenarios apply: site environments and business units
SITE_ENVIRONMENTS = ("PROD", "QA")
MESSAGING_ENVIRONMENTS = ("IWS",)
BUSINESS_UNITS = ("Beef/Pork",)

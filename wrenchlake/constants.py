"""They decide results, so they are stated once, as plain text."""

# A stored phone number: country prefix and ten digits.
PHONE_PATTERN = r"^\+7[0-9]{10}$"

# A phone number as typed through the entry mask "+7 (999) 999-99-99".
MASKED_PHONE_LENGTH = 18
MASK_CHARACTERS = "()- "

# Days covered by the "recent" reports.
RECENT_DAYS = 30

# Raise for a mechanic whose experience changes.
EXPERIENCE_RAISE = 10000

# Separator and currency sign of the display labels.
LABEL_SEPARATOR = " - "
CURRENCY_SIGN = "₽"

# Reason codes of rejected rows.
PART_NOT_FOUND = "part_not_found"
SERVICE_NOT_FOUND = "service_not_found"
INSUFFICIENT_STOCK = "insufficient_stock"
BAD_PHONE = "bad_phone"
PHONE_TAKEN = "phone_taken"
CLIENT_NOT_FOUND = "client_not_found"
DUPLICATE_PLATE = "duplicate_plate"
DUPLICATE_KEY = "duplicate_key"
PART_IN_USE = "part_in_use"
MISSING_FIELD = "missing_field"
SELF_DELETE = "self_delete"
NULL_LIST = "null_list"
EDIT_CONFLICT = "edit_conflict"
CHECK_FAILED = "check_failed"
OK = "ok"

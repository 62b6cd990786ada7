"""Well-known concept ids."""

# fixed values: ids that the release format defines
ROOT = 138875005
IS_A = 116680003
ROLE_GROUP = 609096000
CORE_MODULE = 900000000000207008
MODEL_MODULE = 900000000000012004
PRIMITIVE = 900000000000074008
DEFINED = 900000000000073002
FSN = 900000000000003001
SYNONYM = 900000000000013009
TEXT_DEFINITION = 900000000000550004
INFERRED = 900000000000011006
STATED = 900000000000010007
ADDITIONAL = 900000000000227009
EXISTENTIAL = 900000000000451002
US_ENGLISH = 900000000000509007
GB_ENGLISH = 900000000000508004
PREFERRED = 900000000000548007
ACCEPTABLE = 900000000000549004

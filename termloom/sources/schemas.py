"""The 22 record types of a release and the rules that route a file to one of them.

Field kinds: S identifier, T time, B flag, U unsigned number, X text that must not be empty, x text
that may be, V concrete value, I member id (UUID). All are text in the files.
"""

from __future__ import annotations

from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


@dataclass(frozen=True)
class Record:
    name: str
    fields: tuple[tuple[str, str], ...]

    @property
    def header(self) -> list[str]:
        return [n for n, _ in self.fields]

    @property
    def is_member(self) -> bool:
        return self.fields[0][1] == "I"

    @property
    def schema(self) -> StructType:
        """Columns after typing: a concrete value is a struct of kind, text and number."""
        return StructType([StructField(n, TYPES[k], True) for n, k in self.fields])


VALUE = StructType([StructField("value_type", StringType()), StructField("value", StringType()), StructField("num", DoubleType())])
TYPES = {"S": LongType(), "T": IntegerType(), "B": BooleanType(), "U": LongType(), "X": StringType(), "x": StringType(), "V": VALUE, "I": StringType()}


def record(name: str, spec: str, member: bool = False) -> Record:
    shared = "id:I effectiveTime:T active:B moduleId:S refsetId:S referencedComponentId:S" if member else "id:S effectiveTime:T active:B moduleId:S"
    return Record(name, tuple(tuple(f.split(":")) for f in f"{shared} {spec}".split()))


# fixed values: column names, order and kinds of the release format
COMPONENTS = [
    record("concept", "definitionStatusId:S"),
    record("description", "conceptId:S languageCode:X typeId:S term:X caseSignificanceId:S"),
    record("relationship", "sourceId:S destinationId:S relationshipGroup:U typeId:S characteristicTypeId:S modifierId:S"),
    record("concrete", "sourceId:S value:V relationshipGroup:U typeId:S characteristicTypeId:S modifierId:S"),
]
MEMBERS = [
    record(name, spec, member=True)
    for name, spec in [
        ("simple", ""),
        ("language", "acceptabilityId:S"),
        ("association", "targetComponentId:S"),
        ("attribute_value", "valueId:S"),
        ("simple_map", "mapTarget:X"),
        ("extended_map", "mapGroup:U mapPriority:U mapRule:x mapAdvice:x mapTarget:x correlationId:S mapCategoryId:S"),
        ("owl_expression", "owlExpression:X"),
        ("module_dependency", "sourceEffectiveTime:T targetEffectiveTime:T"),
        ("refset_descriptor", "attributeDescription:S attributeType:S attributeOrder:U"),
        ("description_type", "descriptionFormat:S descriptionLength:U"),
        ("mrcm_domain", "domainConstraint:x parentDomain:x proximalPrimitiveConstraint:x proximalPrimitiveRefinement:x domainTemplateForPrecoordination:x domainTemplateForPostcoordination:x guideURL:x"),
        ("mrcm_attribute_domain", "domainId:S grouped:B attributeCardinality:x attributeInGroupCardinality:x ruleStrengthId:S contentTypeId:S"),
        ("mrcm_attribute_range", "rangeConstraint:x attributeRule:x ruleStrengthId:S contentTypeId:S"),
        ("mrcm_module_scope", "mrcmRuleRefsetId:S"),
        ("ordered_component", "order:U"),
        ("ordered_association", "targetComponentId:S order:U"),
        ("component_annotation", "languageDialectCode:x typeId:S value:X"),
        ("member_annotation", "referencedMemberId:I languageDialectCode:x typeId:S value:X"),
    ]
]
RECORDS = {r.name: r for r in [*COMPONENTS, *MEMBERS]}

# fixed values: content type and summary of the file names of each record type; the first rule that fits holds
ROUTES = [
    ("Concept", "*", "concept"),
    ("Description", "*", "description"),
    ("TextDefinition", "*", "description"),
    ("Relationship", "*", "relationship"),
    ("StatedRelationship", "*", "relationship"),
    ("RelationshipConcreteValues", "*", "concrete"),
    ("Refset", "*", "simple"),
    ("cRefset", "Language", "language"),
    ("cRefset", "MRCMModuleScope", "mrcm_module_scope"),
    ("cRefset", "*Association*", "association"),
    ("cRefset", "*AttributeValue*", "attribute_value"),
    ("sRefset", "SimpleMap", "simple_map"),
    ("sRefset", "OWLExpression", "owl_expression"),
    ("iisssccRefset", "*", "extended_map"),
    ("ssRefset", "ModuleDependency", "module_dependency"),
    ("cciRefset", "RefsetDescriptor", "refset_descriptor"),
    ("ciRefset", "DescriptionType", "description_type"),
    ("sssssssRefset", "MRCMDomain", "mrcm_domain"),
    ("cissccRefset", "MRCMAttributeDomain", "mrcm_attribute_domain"),
    ("ssccRefset", "MRCMAttributeRange", "mrcm_attribute_range"),
    ("iRefset", "OrderedComponent", "ordered_component"),
    ("ciRefset", "OrderedAssociation", "ordered_association"),
    ("scsRefset", "ComponentAnnotationStringValue", "component_annotation"),
    ("sscsRefset", "MemberAnnotationStringValue", "member_annotation"),
]


def route(content_type: str, summary: str) -> Record | None:
    for content, pattern, name in ROUTES:
        if content == content_type and fnmatchcase(summary, pattern):
            return RECORDS[name]
    return None

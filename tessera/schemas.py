"""Shapes of the records, as Spark DDL, and the list caps of a profile."""

from __future__ import annotations

COMPANY = "cnpj_basico string, razao_social string, nome_fantasia string, municipio string"
PAGE = (
    "site string, page_ord bigint, url string, content string, links array<string>, "
    "document_links array<string>, status_code int, error string"
)
CHUNK = (
    "cnpj_basico string, chunk_index bigint, total_chunks bigint, chunk_content string, "
    "token_count bigint, pages_included array<string>"
)
FACT = (
    "cnpj_basico string, chunk_index bigint, ord bigint, section string, value string, "
    "evidence_quote string, confidence double, page_source array<string>"
)

IDENTITY = ["company_name", "cnpj", "tagline", "description", "founding_year", "employee_count_range"]
CLASSIFICATION = ["industry", "business_model", "target_audience", "geographic_coverage"]
CONTACT_TEXT = ["linkedin_url", "website_url", "headquarters_address"]
CATEGORY = "struct<category_name:string,items:array<string>>"
SERVICE = (
    "struct<name:string,description:string,methodology:string,deliverables:array<string>,"
    "ideal_client_profile:string>"
)
CASE_FIELDS = ["title", "client_name", "industry", "challenge", "solution", "outcome"]
CASE = "struct<" + ",".join(f"{f}:string" for f in CASE_FIELDS) + ">"

# The business models a profile may name.
BUSINESS_MODELS = [
    "B2B", "B2C", "B2B2C", "Distribuidor", "Fabricante", "Revendedor",
    "Prestador de Serviços", "Marketplace", "SaaS",
]

# The most items each list of a profile may hold.
LIST_CAPS = {
    "key_roles": 30, "team_certifications": 20,
    "products": 60, "services": 60, "engagement_models": 15, "key_differentiators": 20,
    "product_categories": 40, "service_details": 20,
    "certifications": 30, "awards": 20, "partnerships": 50, "client_list": 80, "case_studies": 15,
    "emails": 10, "phones": 10, "locations": 25,
}
ITEMS_CAP = 80
DELIVERABLES_CAP = 20

OFFERING_LISTS = ["products", "services", "engagement_models", "key_differentiators"]
REPUTATION_LISTS = ["certifications", "awards", "partnerships", "client_list"]
CONTACT_LISTS = ["emails", "phones", "locations"]
TEAM_LISTS = ["key_roles", "team_certifications"]


def _texts(names: list[str]) -> str:
    return ",".join(f"{n}:string" for n in names)


PROFILE = (
    f"struct<identity:struct<{_texts(IDENTITY)}>,"
    f"classification:struct<{_texts(CLASSIFICATION)}>,"
    "team:struct<size_range:string,key_roles:array<string>,team_certifications:array<string>>,"
    "offerings:struct<products:array<string>,services:array<string>,engagement_models:array<string>,"
    f"key_differentiators:array<string>,product_categories:array<{CATEGORY}>,service_details:array<{SERVICE}>>,"
    "reputation:struct<certifications:array<string>,awards:array<string>,partnerships:array<string>,"
    f"client_list:array<string>,case_studies:array<{CASE}>>,"
    "contact:struct<emails:array<string>,phones:array<string>,locations:array<string>,"
    f"{_texts(CONTACT_TEXT)}>,"
    "sources:array<string>>"
)

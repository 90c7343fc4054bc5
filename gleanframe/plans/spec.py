"""Source descriptions: what to look for on the pages of one catalogue.

A spec is data. A further catalogue is one more instance with other selectors and
labels; the builders in ``gleanframe.operators`` stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from gleanframe.functions.dom import Selector, by_attr, by_class, by_tag

PURCHASE = "purchase"
PRODUCT = "product"

# The path parts that mark detail pages of each kind.
NOTICE_PATH = "/epz/order/notice/"
PRODUCT_PATH = "/products/"

# Fixed value: link endings that are documents.
DOCUMENT_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar", ".7z", ".txt")
# Fixed value: link texts that lead to the next list page.
NEXT_TEXTS = ("следующая", "далее", "next", ">", "→")
# Availability texts and the status each one means, first match wins.
AVAILABILITY = (
    ("нет в наличии", "out_of_stock"),
    ("в наличии", "in_stock"),
    ("под заказ", "on_order"),
)

Selectors = tuple[Selector, ...]
Labels = tuple[str, ...]

NEXT_LINKS: Selectors = (
    by_attr("rel", value="next", tag="a"),
    by_class("next", tag="a"),
    by_class("pagination-next", tag="a"),
)


@dataclass(frozen=True)
class SourceSpec:
    """What every catalogue has: a name, a kind, list pages and document links."""

    name: str
    kind: str
    max_pages: int | None
    page_parameters: tuple[str, ...]
    document_markers: tuple[str, ...]
    attachment_fallback: str
    document_extensions: tuple[str, ...] = DOCUMENT_EXTENSIONS
    # A catalogue without reliable dates applies the cutoff on full runs too and has no stop rule.
    cutoff_on_full: bool = False
    stop_rule: bool = True
    list_url: str | None = None


@dataclass(frozen=True)
class PurchaseSpec(SourceSpec):
    """Procurement notices. Defaults are fixed values of the portal's pages."""

    kind: str = PURCHASE
    max_pages: int | None = None
    page_parameters: tuple[str, ...] = ("PAGEN_", "page=", "pageNumber")
    document_markers: tuple[str, ...] = ("скачать", "документ", "файл", "приложение")
    attachment_fallback: str = "procurement-document"
    title_prefix: str = "Закупка "
    detail_path: str = NOTICE_PATH
    entry: Selectors = (
        by_class("registry-entry__form"),
        by_class("registry-entry"),
        by_class("registry-entry__body"),
    )
    number: Selectors = (
        by_class("registry-entry__header-mid__number"),
        by_attr("class", part="notice-number"),
    )
    hint: Selectors = (by_class("registry-entry__header-mid__title"),)
    title: Selectors = (
        by_class("registry-entry__header-mid__title"),
        by_tag("h1"),
        by_class("notice-title"),
    )
    description_meta: Selectors = (by_attr("name", value="description", tag="meta"),)
    description: Selectors = (
        by_class("common-text"),
        by_class("notice-description"),
        by_attr("class", part="description"),
    )
    number_labels: Labels = ("Номер извещения", "Номер закупки")
    customer_labels: Labels = (
        "Заказчик",
        "Наименование заказчика",
        "Организация, осуществляющая закупку",
    )
    status_labels: Labels = ("Статус закупки", "Состояние")
    price_labels: Labels = ("Начальная цена", "НМЦК", "Начальная (максимальная) цена контракта")
    deadline_labels: Labels = ("Окончание подачи заявок", "Дата и время окончания подачи заявок")
    published_labels: Labels = ("Дата размещения", "Размещено", "Дата публикации")
    currency: str = "RUB"
    currency_marker: str = "руб"


@dataclass(frozen=True)
class ProductSpec(SourceSpec):
    """Shop products. Defaults are fixed values of the shop's pages."""

    kind: str = PRODUCT
    max_pages: int | None = None
    page_parameters: tuple[str, ...] = ("PAGEN_", "page=")
    document_markers: tuple[str, ...] = (
        "руководство",
        "инструкция",
        "фотографии",
        "(pdf)",
        "(zip)",
    )
    attachment_fallback: str = "product-attachment"
    cutoff_on_full: bool = True
    stop_rule: bool = False
    # Every product record names the shop itself as customer; the source name if not given.
    customer_name: str | None = None
    detail_path: str = PRODUCT_PATH
    json_ld_type: str = "Product"
    title: Selectors = (
        by_tag("h1"),
        by_attr("itemprop", value="name"),
        by_class("product-name"),
        by_class("detail-title"),
    )
    sku: Selectors = (
        by_attr("itemprop", value="sku"),
        by_class("article"),
        by_class("product-article"),
    )
    description: Selectors = (
        by_attr("itemprop", value="description"),
        by_class("product-description"),
        by_class("description"),
    )
    description_meta: Selectors = (by_attr("name", value="description", tag="meta"),)
    price: Selectors = (
        by_attr("itemprop", value="price"),
        by_class("price"),
        by_attr("class", part="price"),
    )
    price_currency: Selectors = (by_attr("itemprop", value="priceCurrency"),)
    published_meta: Selectors = (
        by_attr("property", value="article:published_time", tag="meta"),
    )
    image: Selectors = (
        by_attr("property", value="og:image", tag="meta"),
        by_attr("itemprop", value="image", tag="img"),
    )
    # Images anywhere below an element of this class count too.
    image_container: str = "product-detail"
    sku_labels: Labels = ("Артикул", "Код товара", "SKU")
    price_labels: Labels = ("Цена", "Цена в интернет-магазине", "Цена онлайн")
    availability_labels: Labels = ("Наличие", "Статус")
    published_labels: Labels = ("Дата публикации", "Дата размещения")
    currency: str = "RUB"
    availability: tuple[tuple[str, str], ...] = field(default=AVAILABILITY)

"""Entry-point categories of Python decorators and Java annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decorators and annotations by the category they stand for; earlier categories win.
PYTHON_ROUTES = {"app": ("post", "get", "put", "delete", "patch", "route"), "router": ("get", "post", "put", "delete", "patch")}
PYTHON_NAMES = {
    "scheduled": ("scheduled_task", "task", "celery.task", "scheduled_job", "app.scheduled"),
    "mq_consumer": ("kafka_handler", "consumer", "rabbitmq.consumer", "redis.pubsub", "subscriber"),
    "event_handler": ("event_handler",),
}
JAVA_NAMES = {
    "http_api": ("GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping", "Path"),
    "scheduled": ("Scheduled",),
    "mq_consumer": ("KafkaListener", "RabbitListener", "JmsListener", "StreamListener"),
    "event_handler": ("EventListener", "TransactionalEventListener"),
    "rpc_service": ("WebService", "RpcService"),
}


def _category(name: Column, names: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*[F.when(name.isin(*known), category) for category, known in names.items()])


def python_category(decorator: Column) -> Column:
    """Of a decorator as written, with or without @ and arguments; null if it marks no entry point.

    Routes go by the first two parts of the dotted name, the others by the whole name.
    """
    name = F.regexp_extract(decorator, r"^\s*@?\s*([A-Za-z_][\w.]*)", 1)
    first_two = F.substring_index(name, ".", 2)
    return F.when(first_two.isin(*[f"{a}.{b}" for a, bs in PYTHON_ROUTES.items() for b in bs]), "http_api").otherwise(_category(name, PYTHON_NAMES))


def java_category(annotation: Column) -> Column:
    """Of an annotation as written, by its simple name; null if it marks no entry point."""
    return _category(F.regexp_extract(annotation, r"^\s*@?\s*(?:\w+\.)*(\w+)", 1), JAVA_NAMES)

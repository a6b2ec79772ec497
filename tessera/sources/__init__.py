from tessera.sources.connectors import JSONSource, KafkaSource, MongoSource, ParquetSource, PostgresSource, Source
from tessera.sources.rest import RESTDataSource, RESTSource

__all__ = ["JSONSource", "KafkaSource", "MongoSource", "ParquetSource", "PostgresSource", "RESTDataSource", "RESTSource", "Source"]

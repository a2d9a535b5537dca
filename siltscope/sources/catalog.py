"""The pattern catalogue: what names a data structure, an algorithm or a design pattern in source code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name, weight, keywords, imports, description.
Pattern = tuple[str, float, list[str], list[str], str]
DSA: list[Pattern] = [
    ("hash_map", 1.5, ["dict", "dictionary", "hashmap", "hash_map", "Counter", "defaultdict"], ["collections.Counter", "collections.defaultdict"], "Hash-based data structures for O(1) lookups"),
    ("set_operations", 1.2, ["set(", "frozenset", ".union", ".intersection", ".difference"], [], "Set operations for unique elements and fast membership"),
    ("sorting", 1.3, ["sorted(", ".sort(", "heapq", "bisect"], ["heapq", "bisect"], "Sorting algorithms and ordered operations"),
    ("binary_search", 2.0, ["bisect_left", "bisect_right", "binary_search", "lo, hi", "mid ="], ["bisect"], "Binary search for O(log n) lookups"),
    ("graph_traversal", 2.5, ["bfs", "dfs", "visited", "queue.append", "stack.append", "neighbors"], ["collections.deque", "networkx"], "Graph traversal algorithms (BFS/DFS)"),
    ("dynamic_programming", 3.0, ["dp[", "memo[", "@lru_cache", "@cache", "memoize"], ["functools.lru_cache", "functools.cache"], "Dynamic programming and memoization"),
    ("tree_structures", 2.0, ["TreeNode", "left_child", "right_child", "parent", "root.left", "root.right"], [], "Tree data structures"),
    ("linked_list", 1.5, ["ListNode", "next_node", "head.next", "prev", "curr.next"], [], "Linked list implementations"),
    ("queue_stack", 1.2, ["deque", "queue", "stack", "LIFO", "FIFO", "push", "pop"], ["collections.deque", "queue.Queue"], "Queue and stack data structures"),
    ("heap_priority", 2.0, ["heappush", "heappop", "heapify", "PriorityQueue", "nlargest", "nsmallest"], ["heapq", "queue.PriorityQueue"], "Heap/priority queue for efficient min/max operations"),
    ("trie", 2.5, ["TrieNode", "Trie", "prefix_tree", "children[", "is_end", "insert_word", "search_prefix"], ["pygtrie", "marisa_trie"], "Trie/prefix tree for string operations"),
    ("union_find", 2.5, ["UnionFind", "DisjointSet", "find_parent", "union(", "parent[", "rank[", "path_compression"], [], "Union-Find/Disjoint Set for connectivity"),
    ("topological_sort", 2.5, ["topological", "toposort", "in_degree", "indegree", "kahn", "dag"], ["graphlib", "toposort"], "Topological sorting for DAG ordering"),
    ("sliding_window", 2.0, ["window_start", "window_end", "left_ptr", "right_ptr", "window_size", "shrink_window", "expand_window"], [], "Sliding window technique for subarray problems"),
    ("two_pointers", 1.5, ["two_pointer", "left_pointer", "right_pointer", "slow_fast", "fast_slow", "tortoise_hare"], [], "Two pointers technique for array traversal"),
    ("backtracking", 2.5, ["backtrack", "backtracking", "choose", "unchoose", "explore", "is_valid_state"], [], "Backtracking for constraint satisfaction"),
    ("segment_tree", 3.0, ["SegmentTree", "segment_tree", "range_query", "range_update", "build_tree", "query_range"], [], "Segment tree for range queries"),
    ("fenwick_tree", 3.0, ["FenwickTree", "BinaryIndexedTree", "BIT", "prefix_sum", "update_bit", "query_bit"], [], "Fenwick/Binary Indexed Tree for prefix operations"),
    ("lru_cache_manual", 2.0, ["OrderedDict", "move_to_end", "popitem", "capacity", "cache_hit", "cache_miss", "evict"], ["collections.OrderedDict"], "Manual LRU cache implementation"),
    ("bloom_filter", 2.5, ["BloomFilter", "bloom_filter", "hash_functions", "bit_array", "false_positive"], ["pybloom", "bloom_filter", "bitarray"], "Bloom filter for probabilistic membership"),
    ("dijkstra", 2.5, ["dijkstra", "shortest_path", "distance[", "dist[", "relaxation", "bellman_ford"], ["networkx.dijkstra", "networkx.shortest_path"], "Shortest path algorithms (Dijkstra/Bellman-Ford)"),
    ("minimum_spanning_tree", 2.5, ["kruskal", "prim", "mst", "minimum_spanning", "spanning_tree"], ["networkx.minimum_spanning_tree"], "Minimum spanning tree algorithms"),
    ("monotonic_stack", 2.0, ["monotonic_stack", "mono_stack", "next_greater", "next_smaller", "previous_greater"], [], "Monotonic stack for next greater/smaller element"),
    ("interval_operations", 2.0, ["merge_intervals", "interval_overlap", "interval_intersection", "start_end", "intervals.sort"], ["intervaltree"], "Interval merging and overlap detection"),
]
# Fixed values, in the same form.
DESIGN: list[Pattern] = [
    ("api_design", 2.0, ["@app.route", "@router", "APIRouter", "FastAPI", "Flask", "endpoint"], ["fastapi", "flask", "django.urls"], "RESTful API design"),
    ("database_orm", 2.0, ["Base.metadata", "session.query", "Model", "ForeignKey", "relationship"], ["sqlalchemy", "django.db", "peewee", "tortoise"], "Database ORM patterns"),
    ("caching", 2.5, ["cache", "redis", "memcached", "@cached", "cache_key", "ttl"], ["redis", "cachetools", "django.core.cache"], "Caching layer implementation"),
    ("message_queue", 3.0, ["celery", "rabbitmq", "kafka", "sqs", "publish", "subscribe", "consumer"], ["celery", "pika", "kafka", "boto3.client('sqs')"], "Message queue/async processing"),
    ("factory_pattern", 1.5, ["Factory", "create_", "get_instance", "register", "build"], [], "Factory design pattern"),
    ("singleton_pattern", 1.0, ["_instance", "__new__", "getInstance", "Singleton"], [], "Singleton design pattern"),
    ("dependency_injection", 2.5, ["Depends", "inject", "@inject", "Container", "provider"], ["dependency_injector", "fastapi.Depends"], "Dependency injection pattern"),
    ("error_handling", 1.5, ["try:", "except", "raise", "HTTPException", "custom exception", "ErrorHandler"], [], "Structured error handling"),
    ("logging", 1.5, ["logging", "logger", "log.info", "log.error", "log.debug"], ["logging", "structlog", "loguru"], "Logging implementation"),
    ("authentication", 2.5, ["jwt", "token", "authenticate", "authorize", "OAuth", "bearer", "password_hash"], ["jwt", "passlib", "python-jose", "authlib"], "Authentication/Authorization"),
    ("testing", 2.0, ["pytest", "unittest", "mock", "fixture", "assert", "test_"], ["pytest", "unittest", "mock"], "Testing patterns"),
    ("microservices", 2.5, ["service", "client", "grpc", "proto", "api_client", "ServiceClient"], ["grpc", "httpx", "aiohttp"], "Microservices architecture"),
    ("repository_pattern", 2.0, ["Repository", "BaseRepository", "get_by_id", "find_all", "save", "delete"], [], "Repository pattern for data access"),
    ("config_management", 1.5, ["Settings", "Config", "env", "getenv", "pydantic.BaseSettings"], ["pydantic", "python-dotenv", "dynaconf"], "Configuration management"),
]
SCHEMA = "category string, pattern string, pattern_ord int, weight double, description string, keywords array<string>, imports array<string>"


def entries() -> list[tuple]:
    """Rows of SCHEMA, in catalogue order."""
    return [(category, name, k, weight, about, keywords, imports) for category, table in (("dsa", DSA), ("design", DESIGN)) for k, (name, weight, keywords, imports, about) in enumerate(table)]


def catalog(spark: SparkSession) -> DataFrame:
    """The built-in catalogue. Operators take any DataFrame of this schema, so that users can add patterns."""
    return spark.createDataFrame(entries(), SCHEMA)

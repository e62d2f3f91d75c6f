import json

from sitequarry.operators import content

POSTS = [
    {"id": 1, "date": "2024-01-01T00:00:00", "title": {"rendered": "Hello World"}, "content": {"rendered": "<p>Welcome</p>"},
     "excerpt": {"rendered": "W"}, "author": 1, "featured_media": 0, "categories": [5], "tags": []},
    {"id": 2, "date": "2024-01-02T00:00:00", "title": {"rendered": "Sample"}, "content": {"rendered": "world"}, "author": 2,
     "status": "draft", "categories": [5, 6], "tags": [1]},
    {"id": 3, "date": "never", "title": "flat", "author": "x", "categories": [7]},
]


def records(spark, items):
    return spark.createDataFrame([(json.dumps(i),) for i in items], "record_json string")


def ids(frame):
    return [r.id for r in frame.collect()]


def test_posts(spark):
    posts = content.posts(records(spark, POSTS))
    by_id = {r.id: r for r in posts.collect()}
    assert by_id[1].title == "Hello World" and by_id[1].status == "publish" and by_id[2].status == "draft"
    assert by_id[3].date is None and by_id[3].title is None and by_id[3].author is None
    assert ids(content.between_dates(posts, after="2024-01-01T00:00:00")) == [2]
    assert ids(content.between_dates(posts, before="2024-01-02T00:00:00")) == [1]
    assert sorted(ids(content.search(posts, "WORLD"))) == [1, 2]
    assert sorted(ids(content.with_terms(posts, "categories", "5,7"))) == [1, 2, 3]
    assert ids(content.with_terms(posts, "tags", [1])) == [2]
    assert sorted(ids(content.with_values(posts, "author", "1, 2"))) == [1, 2] and ids(content.with_values(posts, "author", 2)) == [2]
    assert sorted(ids(content.with_status(posts))) == [1, 3]
    assert ids(content.ordered(posts, "id", "desc")) == [3, 2, 1]
    assert ids(content.page_of(content.ordered(posts, "id", "asc"), page=2, per_page=2)) == [3]
    assert ids(content.page_of(content.ordered(posts, "id", "asc"), per_page=1, offset=1)) == [2]


def test_terms_users_comments(spark):
    posts = content.posts(records(spark, POSTS))
    terms = content.terms(records(spark, [{"id": 5, "name": "News", "slug": "news", "parent": 0}, {"id": 6, "name": "World", "parent": 5}]))
    assert {r.id: r["count"] for r in content.terms_with_counts(terms, posts).collect()} == {5: 2, 6: 1}
    assert sorted(ids(content.terms_of_post(terms, posts, 2))) == [5, 6] and ids(content.terms_by(terms, parent=5)) == [6]
    users = content.users(records(spark, [{"id": 1, "name": "A", "roles": ["editor"]}, {"id": 9, "name": "B", "roles": ["author", "x"]}]))
    assert ids(content.users_with_roles(users, "author,admin")) == [9] and ids(content.authors(users, posts)) == [1]
    comments = content.comments(records(spark, [{"id": 1, "post": 2, "parent": 0, "author": 4}, {"id": 2, "post": 8, "parent": 1}]))
    assert ids(content.comments_by(comments, post=2, author=4)) == [1] and ids(content.comments_by(comments, parent=1)) == [2]
    assert content.comments_with_posts(comments, posts).first().post_title == "Sample"
    media = content.media_items(records(spark, [{"id": 1, "media_type": "image", "mime_type": "image/png", "post": 3}, {"id": 2, "media_type": "file"}]))
    assert ids(content.media_by(media, media_type="image", parent=3)) == [1]
    views = {("post", "post"): posts, ("term", "category"): terms}
    found = content.search_all(views, "world").collect()
    assert sorted((r.type, r.id) for r in found) == [("post", 1), ("post", 2), ("term", 6)]
    assert ids(content.search_all(views, "world", types=["term"])) == [6]


def test_dictionaries_and_errors(spark):
    body = '{"post":{"name":"Posts","slug":"post","supports":{"title":true}},"page":{"name":"Pages"}}'
    documents = spark.createDataFrame([("d", "/wp/v2/types", body), ("d", "/x", None)], "domain string, route string, body string")
    assert sorted((r.key, r.name, r.slug) for r in content.dictionary_entries(documents).collect()) == [
        ("page", "Pages", None), ("post", "Posts", "post")]
    bad = '{"code":"rest_invalid_param","message":"m","data":{"status":400,"params":{"per_page":"per_page must be between 1 and 100"}}}'
    responses = spark.createDataFrame([("d", "/a", 400, bad), ("d", "/b", 404, "<html>"), ("d", "/c", 200, bad)],
                                      "domain string, route string, status int, body string")
    errors = content.error_bodies(responses)
    assert [(r.code, r.data_status, r.bad_params) for r in errors.collect()] == [("rest_invalid_param", 400, ["per_page"])]
    assert content.error_counts(errors).first().n_errors == 1


def test_sites_keep_apart(spark):
    posts = spark.createDataFrame([("a", 1, 7, [5]), ("a", 2, 7, [5, 6]), ("b", 1, 8, [6]), ("c", 3, 9, [5])],
                                  "domain string, id long, author long, categories array<long>")
    terms = spark.createDataFrame([(d, i, f"{d}{i}") for d in "abc" for i in (5, 6)], "domain string, id long, name string")
    counts = {(r.domain, r.id): r["count"] for r in content.terms_with_counts(terms, posts).collect()}
    assert counts == {("a", 5): 2, ("a", 6): 1, ("b", 5): 0, ("b", 6): 1, ("c", 5): 1, ("c", 6): 0}
    assert [r.name for r in content.terms_of_post(terms, posts, 1, domain="b").collect()] == ["b6"]
    assert sorted(r.name for r in content.terms_of_post(terms, posts, 1).collect()) == ["a5", "b6"]
    users = spark.createDataFrame([(d, i, f"{d}{i}") for d in "abc" for i in (7, 8)], "domain string, id long, name string")
    assert sorted(r.name for r in content.authors(users, posts).collect()) == ["a7", "b8"]
    found = content.search_all({("term", "category"): terms, ("user", "user"): users}, "b").collect()
    assert sorted((r.domain, r.id) for r in found) == [("b", 5), ("b", 6), ("b", 7), ("b", 8)]


def test_pages_of_several_sites(spark):
    rows = [(d, json.dumps({"id": i, "date": f"2024-01-{1 + i % 3:02d}T00:00:00"})) for d, n in [("a", 9), ("b", 4)] for i in range(n)]
    posts = content.posts(spark.createDataFrame(rows, "domain string, record_json string"))
    found = [(r.domain, r.place, r.id) for r in content.page_per_site(posts, page=2, per_page=3).orderBy("domain", "place").collect()]
    assert found == [("a", 4, 7), ("a", 5, 4), ("a", 6, 1), ("b", 4, 0)]
    assert [r.id for r in content.page_per_site(posts, "id", "asc", per_page=1, offset=3).orderBy("domain").collect()] == [3, 3]

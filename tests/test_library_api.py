"""A library through a few changes."""

import pytest

from photark.plans import library_api
from photark.plans.library_api import Library


@pytest.fixture(scope="module")
def lib(spark):
    made = Library.empty(spark)
    return made.scanned(made.rows("items", [("/a/owl.jpg", "owl.jpg", 20), ("/a/cat.jpg", "cat.jpg", None), ("/a/dog.jpg", "dog.jpg", 30)]))


def test_listing(lib):
    now = lib.rate("/a/owl.jpg", 4, 1).rate("/a/owl.jpg", 5, 2).tag("/a/owl.jpg", [" bird ", "night", "bird"]).tag("/a/cat.jpg", []).save_version("/a/owl.jpg", "v1", 1, "[]").save_version("/a/owl.jpg", "v2", 2, "[]")
    rows = [tuple(r) for r in now.listing().collect()]
    assert rows == [("/a/dog.jpg", "dog.jpg", 30, None, [], None), ("/a/owl.jpg", "owl.jpg", 20, 5, ["bird", "night"], "v2"), ("/a/cat.jpg", "cat.jpg", None, None, [], None)]
    assert [r["path"] for r in now.listing(search="BIRD, owl").collect()] == ["/a/owl.jpg"]
    assert [(r["id"], r["display_index"]) for r in now.history("/a/owl.jpg").collect()] == [("v2", 2), ("v1", 1)]
    assert now.rate("/a/owl.jpg", None, 3).ratings.count() == 0
    assert now.tags.where("tag = ''").count() == 1
    with pytest.raises(ValueError, match="1 to 5"):
        now.rate("/a/owl.jpg", 6, 1)


def test_collections(lib):
    now = lib.add_collection("c1", " Pets ").add_members("c1", ["/a/dog.jpg", "/a/cat.jpg", "/a/dog.jpg"]).add_members("c1", ["/a/cat.jpg", "/a/owl.jpg"]).add_collection("c2", "Empty")
    assert [(r["id"], r["name"], r["position"], r["n_items"]) for r in now.collection_list().collect()] == [("c1", "Pets", 0, 3), ("c2", "Empty", 1, 0)]
    assert sorted((r["path"], r["position"]) for r in now.members.collect()) == [("/a/cat.jpg", 1), ("/a/dog.jpg", 0), ("/a/owl.jpg", 2)]
    assert now.listing(collection="c1").count() == 3 and now.listing(collection="c2").count() == 3
    assert now.drop_collection("c1").members.count() == 0


def test_peer_and_preset(lib):
    now = lib.rate("/a/owl.jpg", 4, 5)
    now = now.merge_peer(now.rows("ratings", [("/a/owl.jpg", 1, 5), ("/a/dog.jpg", 2, 1)]), now.rows("tags", [("/a/dog.jpg", "pet")]))
    assert sorted((r["path"], r["rating"]) for r in now.ratings.collect()) == [("/a/dog.jpg", 2), ("/a/owl.jpg", 4)]
    assert now.apply_preset(["/a/owl.jpg", "/a/cat.jpg"], "[]", 9).clear_versions(["/a/cat.jpg"]).versions.count() == 1


def test_plans_do_not_grow_without_end(spark):
    own = library_api.Library.empty(spark)
    for i in range(2 * library_api.CUT + 1):
        own = own.rate(f"p{i % 3}", 1 + i % 5, i)
    assert own.ratings.count() == 3 and own.changes["ratings"] == 1
    assert len(own.ratings._jdf.queryExecution().logical().toString()) < 3000

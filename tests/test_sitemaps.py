"""Sitemap locations: entities, CDATA, prefixes, broken tails, and linear time."""

from __future__ import annotations

import time

import pytest

from citeframe.sources.sitemap_xml import locations

CASES = [
    ("<urlset><url><loc>https://a/x?p=1&amp;q=2&#38;r=&#x33;&quot;</loc></url></urlset>", ['https://a/x?p=1&q=2&r=3"']),
    ("<urlset><url><loc><![CDATA[ https://a/<x>&amp; ]]></loc></url></urlset>", ["https://a/<x>&amp;"]),
    ("<s:urlset xmlns:s='u'><s:url><s:loc>https://a/1</s:loc><image:image><image:loc>https://i</image:loc></image:image></s:url></s:urlset>", ["https://a/1"]),
    ("<urlset><url><image:image><image:loc>https://i</image:loc></image:image><loc>https://a/2</loc><loc>https://no</loc></url></urlset>", ["https://a/2"]),
    ("<urlset><url><loc>https://a/3</loc></url><url><loc>https://a/4</loc></url><url><loc>https://cut", ["https://a/3", "https://a/4"]),
    ("<urlset><url><loc>https://a/5</loc><url", ["https://a/5"]),
    ("<sitemapindex><sitemap><loc>https://a/s.xml</loc></sitemap></sitemapindex>", ["https://a/s.xml"]),
    ("<x><sitemap><loc>https://a/s.xml</loc></sitemap><url><loc>https://a/6</loc></url></x>", ["https://a/6"]),
    ("<?xml version='1.0'?><!DOCTYPE x [<!ENTITY a '>'>]><!-- <url><loc>no</loc></url> --><urlset a='>'><url b=\">\"><loc>\n https://a/7 <!-- c --></loc></url></urlset>", ["https://a/7"]),
    ("<urlset><url><loc/></url><url><loc></loc></url><url/></urlset>", []), ("", []), (None, []), ("plain", []), ("<", []), ("<!-- open <url><loc>x</loc></url>", []),
    ("<urlset><url><loc>https://a/8?q=&unknown;&amp</loc></url></urlset>", ["https://a/8?q=&unknown;&amp"]),
]


@pytest.mark.parametrize("xml,want", CASES)
def test_locations(xml, want):
    assert locations(xml) == want


@pytest.mark.parametrize("part", ["<url><loc>https://a</loc></url>", "<url>", "<!--", "<a b=\"", "<url><loc>", "<![CDATA[", "&amp;<", "<x></y>", "<url><x></y>"])
def test_linear_time(part):
    def seconds(n):
        start = time.perf_counter()
        locations("<urlset><url>" + part * n)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(40_000) < 12 * seconds(10_000) + 0.3
